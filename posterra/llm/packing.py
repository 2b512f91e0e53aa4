"""Best-fit packing of documents into sequences of several permitted lengths.

Items are documents by their number of words; one longer than the largest capacity is
cut into full pieces and a rest, each an item. Items are dealt to shards of about
``SHARD_ITEMS`` by a hash of their key (a hot source or a group of copies spreads like
anything else) and each shard is packed on its own, largest items first: an item goes to
the open bin that it leaves with the least room, else it opens a bin. A bin of capacity
``C`` costs ``C * (1 + C / ATTENTION) + BIN_COST``: attention grows with the square of a
sequence, all else with its length, and each sequence has a fixed price. So a short
sequence is the cheaper one a word where it can be filled, and a long one where it can't.
All permitted capacities are weighed together for every bin: each is filled, in thought,
with the largest items still to come that fit, and the one of least cost a word filled is
opened. At the end each bin is downsized to the smallest capacity that holds its contents.

Cases: a null, empty or blank text has no words and is in no bin; items of equal size go
by key; rows sharing a key, and equal rows, are separate items; rows with a null key are
packed after the others of their size; columns other than the named ones are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .textblocks import blocks

CAPACITIES = (512, 1024, 2048, 4096)
#: Words of a sequence at which attention costs as much as all else, and the price of a sequence in words.
ATTENTION = 32768
BIN_COST = 8
SHARD_ITEMS = 4096


def cost(capacity: int, attention: int = ATTENTION, bin_cost: int = BIN_COST) -> float:
    """Price of a sequence, in words of a short one."""
    return capacity * (1 + capacity / attention) + bin_cost


def fill(room: int, ahead: list[int], n: int) -> int:
    """Words of ``room`` that the first ``n`` of the ascending sizes ``ahead`` take, the largest that fits first."""
    left = room
    while n and left >= ahead[0]:
        n = bisect_right(ahead, left, 0, n)
        n -= 1
        left -= ahead[n]
    return room - left


def opening(size: int, ahead: list[int], n: int, capacities: tuple[int, ...], attention: int = ATTENTION, bin_cost: int = BIN_COST) -> int:
    """Capacity of least cost a word for an item of ``size`` with the first ``n`` of ``ahead`` to come; ties: the smaller."""
    able = [c for c in capacities if c >= size]
    return min(able, key=lambda c: cost(c, attention, bin_cost) / (size + fill(c - size, ahead, n)))


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, attention: int = ATTENTION, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, each bin's final capacity and the one it was opened with; items in decreasing size order."""
    capacities = tuple(sorted(capacities))
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    room: list[tuple[int, int]] = []
    ahead = sizes[::-1].tolist()
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            b = len(used)
            used.append(0)
            space = opening(size, ahead, len(sizes) - 1 - i, capacities, attention, bin_cost)
            opened.append(space)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if space > size:
            insort(room, (space - size, b))
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final, np.array(opened, dtype=np.int64)


def _items(batches: Iterator[pa.RecordBatch], largest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            n = block.words().counts
            pieces = -(-n // largest)
            row = np.repeat(np.arange(len(block)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[row] - piece * largest, largest)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["doc_id", "piece", "size"],
                )


def _packed(capacities: tuple[int, ...], attention: int, bin_cost: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final, opened = pack(group["size"].to_numpy(), capacities, attention, bin_cost)
        return pd.DataFrame(
            {
                "bin_id": (shard << 32) + bins, "capacity": final[bins].astype(np.int32), "doc_id": group["doc_id"].astype("Int64"),
                "piece": group["piece"], "bin_offset": offsets.astype(np.int32), "n_words": group["size"], "opened": opened[bins].astype(np.int32),
            }
        )

    return run


def best_fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, attention: int = ATTENTION, bin_cost: int = BIN_COST, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """(bin_id, capacity, doc_id, piece, bin_offset, n_words, opened): one row per item, n_words words from ``piece * max(capacities)``."""
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # an item is a few bytes, whatever its text; they are counted, as one text may make many
    items = checkpointed(body.mapInArrow(lambda it: _items(it, max(capacities)), "doc_id long, piece int, size int"))
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    schema = "bin_id long, capacity int, doc_id long, piece int, bin_offset int, n_words int, opened int"
    return items.groupBy("shard").applyInPandas(_packed(tuple(sorted(capacities)), attention, bin_cost), schema)
