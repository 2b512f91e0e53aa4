"""Tables of fixed size that every task adds to and every task gets: counts by slot, and filters of keys.

A task sends its table in compressed rows of ``CHUNK`` slots, those that it used; the rows
of a chunk are added up in one task, as they come, and the chunks' results meet on the
driver. What is gathered and broadcast is a byte a slot or less, whatever was counted. More
keys than slots make a table say less, never something wrong: a count can only be too
large, and a filter can only let through what it should not.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import partitions
from .textblocks import mix

CHUNK = 1 << 14
#: Bits of a filter: 16 a key that is in it, which lets one other key in 150 through, from 8 MB to 64 MB; over 200,000,000 keys it lets more than a third through.
FILTER_BITS, MOST_BITS, KEY_BITS = 1 << 26, 1 << 29, 16
_PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def packed(table: np.ndarray, chunk: int = CHUNK) -> pa.RecordBatch | None:
    """(chunk, packed) rows of the chunks of a task's table that are not all zero."""
    rows = table.reshape(-1, chunk)
    used = np.flatnonzero(rows.any(axis=1))
    if len(used):
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in used], pa.binary())], names=["chunk", "packed"])
    return None


def _added(batches: Iterator[pa.RecordBatch], dtype: str, add: Callable, done: Callable) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(raw), dtype=dtype)
            sums[chunk] = add(sums[chunk], own) if chunk in sums else own.astype(np.uint64 if add is np.add else dtype)
    for chunk, total in sums.items():
        final = done(total).astype(np.uint8)
        if final.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([final.tobytes()], pa.binary())], names=["chunk", "bytes"])


def gathered(rows: DataFrame, size: int, dtype: str, done: Callable, add: Callable = np.add, chunk: int = CHUNK) -> np.ndarray:
    """One byte a slot: ``done`` of the sums of all tasks' (chunk, packed) rows."""
    table = np.zeros(size, dtype=np.uint8)
    found = rows.repartition(partitions(rows.sparkSession), "chunk").mapInArrow(lambda it: _added(it, dtype, add, done), "chunk int, bytes binary").toArrow()
    for number, own in zip(*(column.to_pylist() for column in found.columns), strict=True):
        table[number * chunk : (number + 1) * chunk] = np.frombuffer(own, dtype=np.uint8)
    return table


def filter_bits(keys: int) -> int:
    """Bits of a filter of so many keys: a power of two."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (KEY_BITS * keys - 1).bit_length() if keys else 0))


def _probes(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for salt in _PROBES:
        yield (mix(keys.view(np.uint64) ^ np.uint64(salt)) % np.uint64(size)).astype(np.int64)


def _noted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(size // 8, dtype=np.uint8)
    for batch in batches:
        for at in _probes(batch.column(0).to_numpy(), size):
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    if (out := packed(bits)) is not None:
        yield out


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the only column of ``keys``, a long without nulls, as large as their number wants; they are read twice."""
    size = filter_bits(keys.count())
    return gathered(keys.mapInArrow(lambda it: _noted(it, size), "chunk int, packed binary"), size // 8, "u1", lambda x: x, np.bitwise_or)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the filter; some are said to be that are not."""
    out = np.ones(len(keys), dtype=bool)
    for at in _probes(keys, 8 * len(bits)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
