"""Vectorised access to batches of texts.

An Arrow batch is cut into blocks of about ``BLOCK_BYTES`` of UTF-8 text (a
longer text makes a block of its own, so no text is ever cut), and every
operator works on the block's single byte array with numpy. Working memory is
a small multiple of the block, whatever the batch or the partition holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

#: Bytes that separate words: space and \t \n \v \f \r.
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z, leaves every other byte.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up = np.full(size, _BASE, dtype=np.uint64)
            cls.up[0] = 1
            np.cumprod(cls.up, out=cls.up)
            cls.down = np.full(size, _BASE_INVERSE, dtype=np.uint64)
            cls.down[0] = 1
            np.cumprod(cls.down, out=cls.down)
        return cls.up, cls.down


class RangeHasher:
    """64-bit hash of any contiguous range of a sequence in constant time."""

    def __init__(self, codes: np.ndarray):
        self.up, self.down = _Powers.upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Some rows of a batch: their texts as one byte array with offsets."""

    first: int
    buf: np.ndarray
    offs: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self) -> Words:
        return Words(self.buf, self.offs)

    def text(self) -> str:
        return self.buf.tobytes().decode("utf-8", "replace")


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block; ``ptr[d]:ptr[d+1]`` are those of text d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        inside = ~IS_SEPARATOR[buf]
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~inside[1:]
        before |= cut[:n]
        after |= cut[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.inside = inside
        self.ptr = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.ptr)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        return byte_hasher(buf).of(self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) of the k-word windows within texts, and their texts."""
        doc = self.doc()
        at = np.arange(len(doc))
        ok = at + k <= self.ptr[doc + 1]
        return at[ok], doc[ok]


def byte_hasher(buf: np.ndarray) -> RangeHasher:
    return RangeHasher(_BYTE_CODES[buf])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of an Arrow string column."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0], np.asarray(column.is_valid())


_LIBC = ctypes.CDLL(None)


def release_unused() -> None:
    """Give freed memory back, which a worker would else keep for as long as it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of consecutive whole texts; a null text is an empty one with ``valid`` false."""
    buf, offs, valid = strings(column)
    n, first = len(valid), 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first], valid[first:last])
        first = last
    release_unused()


# --- characters ---------------------------------------------------------------------------------

SYMBOL_BITS = 16
_UNIT_TABLE: np.ndarray | None = None
_LETTER_TABLE: np.ndarray | None = None


def _unit_table() -> np.ndarray:
    """UTF-16 unit to symbol: lower case, digits as 0, white space and controls as a blank; every other unit is itself."""
    global _UNIT_TABLE
    if _UNIT_TABLE is None:
        out = np.arange(0x10000, dtype=np.uint16)
        for c in [*range(0xD800), *range(0xE000, 0x10000)]:
            s, low = chr(c), chr(c).lower()
            out[c] = 0x20 if s.isspace() or c < 0x20 else 0x30 if s.isdigit() else ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        _UNIT_TABLE = out
    return _UNIT_TABLE


def letter_table() -> np.ndarray:
    """Whether a code point is a letter (Unicode category L)."""
    global _LETTER_TABLE
    if _LETTER_TABLE is None:
        _LETTER_TABLE = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER_TABLE


def has_letter(block: Block) -> np.ndarray:
    """Whether each text of a block has a letter."""
    points = np.frombuffer(block.text().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = (block.buf & 0xC0) != 0x80
    upto = np.zeros(len(block.buf) + 1, dtype=np.int64)
    np.cumsum(lead, out=upto[1:])
    letters = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(letter_table()[points], out=letters[1:])
    return np.diff(letters[upto[block.offs]]) > 0


@dataclass
class Characters:
    """Symbols of a block, one a UTF-16 unit, so that no two characters share one but for case, digits and blanks; ``offs`` are the texts' offsets."""

    symbols: np.ndarray
    offs: np.ndarray

    @staticmethod
    def of(block: Block) -> Characters:
        units = ((block.buf & 0xC0) != 0x80).astype(np.int64) + (block.buf >= 0xF0)
        upto = np.zeros(len(block.buf) + 1, dtype=np.int64)
        np.cumsum(units, out=upto[1:])
        return Characters(_unit_table()[np.frombuffer(block.text().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)], upto[block.offs])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed k-grams of symbols that lie within one text, and the text of each."""
        s = self.symbols.astype(np.uint64)
        n = len(s) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = s[:n].copy()
        for j in range(1, k):
            g <<= np.uint64(SYMBOL_BITS)
            g |= s[j : n + j]
        doc = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))[:n]
        ok = np.arange(n) + k <= self.offs[doc + 1]
        return g[ok], doc[ok]


class GramCounter:
    """Exact counts of packed n-grams, merged as sorted arrays."""

    def __init__(self, pending: int = 1 << 21):
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size, self.pending = 0, pending

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size >= self.pending:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        new = np.sort(np.concatenate(self.waiting))
        self.waiting, self.size = [], 0
        edge = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))
        keys, counts = new[edge], np.diff(np.append(edge, len(new)))
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys, self.counts = keys[edge], np.add.reduceat(counts, edge)


def count_grams(batches: Iterator[pa.RecordBatch], k: int, group: int = 0, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Counts of character k-grams by group (a string column) over all the batches of a task."""
    counters: dict[str, GramCounter] = {}
    for batch in batches:
        names = batch.column(group).to_pylist()
        for block in blocks(batch.column(text)):
            grams, doc = Characters.of(block).grams(k)
            own = names[block.first : block.first + len(block)]
            distinct = sorted(set(own))
            number = np.array([distinct.index(x) for x in own], dtype=np.int64)[doc] if len(doc) else doc
            for i, name in enumerate(distinct):
                counters.setdefault(name, GramCounter()).add(grams[number == i])
    for name, counter in counters.items():
        counter.merge()
        for at in range(0, len(counter.keys), 1 << 16):
            keys = counter.keys[at : at + (1 << 16)].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counter.counts[at : at + (1 << 16)])],
                names=["grp", "gram", "cnt"],
            )
