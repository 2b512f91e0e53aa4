"""Periodic runs of words, by the runs theorem.

A run is a maximal stretch of words with a smallest period ``q``; those of at least
``max(shortest, times * q)`` words are returned. Every run has a root that is the longest
Lyndon word at its start under one of two opposite orders of the words, and that word ends
where the inverse suffix array has its next smaller (or next greater) value. So each word
gives two candidates, which are extended to the right by the longest common prefix of two
suffixes and to the left by that of two suffixes of the reversed words; both are range minima of an
LCP array in a sparse table. What reaches ``times`` periods is a run, whatever its period.

Before that, words that lie in no run are left out. Within a run every word but the first
``q`` occurred at most ``q`` words before, and there are at least ``(times - 1) * q`` such
words in a row. For each power of two, stretches that are long enough for a period up to it, and the words in front that its
first period can take, are gone into; no run is lost or cut, as a run lies whole in its stretch.

All texts of a block are worked on at once, with the stretch as first sort key. Memory is
about 150 bytes a word of the stretches of a block (half a megabyte of text, or one longer
text). Nothing is exchanged between tasks.

Cases: null, empty and blank texts have no words, no run and an empty collapsed text; a null
key stays null; equal rows get equal rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks

SHORTEST = 6
TIMES = 4
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


# --- suffixes -----------------------------------------------------------------------------------


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry i of level l is the least of the 2^l values from i on."""
    out = [values]
    while (half := 1 << (len(out) - 1)) * 2 <= len(values):
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


class Suffixes:
    """Order and common prefixes of the suffixes of several sequences, ``ends`` being where each position's own sequence ends."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        self.n, self.ends = len(symbols), ends
        at = np.arange(self.n)
        rank = np.unique(ends * (int(symbols.max(initial=0)) + 1) + symbols, return_inverse=True)[1]
        levels, span = [rank.astype(np.int32)], 1
        while int(rank.max(initial=-1)) + 1 < self.n:
            after = at + span
            key = rank * (self.n + 1) + np.where(after < ends, rank[np.minimum(after, self.n - 1)] + 1, 0)
            rank = np.unique(key, return_inverse=True)[1]
            levels.append(rank.astype(np.int32))
            span *= 2
        self.rank = rank
        order = np.empty(self.n, dtype=np.int64)
        order[rank] = at
        self.table = _minima(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each suffix and the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        a_end, b_end = self.ends[a], self.ends[b]
        out = np.zeros(len(a), dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < a_end) & (b < b_end))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for x in (a, b, out):
                x[same] += 1 << k
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j of one sequence, i and j being different and within it."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            row = self.table[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the number of values."""
    n, table = len(values), _minima(values)
    at = np.arange(1, n + 1)
    for k in range(len(table) - 1, -1, -1):
        open_ = np.flatnonzero(at + (1 << k) <= n)
        larger = open_[table[k][at[open_]] > values[open_]]
        at[larger] += 1 << k
    return at


def lyndon_runs(symbols: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Distinct (start, length, period) rows, by start and period, of the sequences ``symbols[bounds[k]:bounds[k + 1]]``; starts count from the first."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), dtype=np.int64)
    sizes = np.diff(bounds)
    firsts, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    forward = Suffixes(symbols, ends)
    at = np.arange(n)
    roots = [np.minimum(next_smaller(ranks), ends) for ranks in (forward.rank, -forward.rank)]
    i, j = np.concatenate((at, at)), np.concatenate(roots)
    period = j - i
    # the end of a sequence is the smallest symbol of the first order and the greatest of the second, where a root that reaches it goes on beyond
    able = (times * period <= ends[i] - firsts[i]) & ((np.arange(2 * n) < n) | (j < ends[i]))
    i, j, period = i[able], j[able], period[able]
    right = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(j < ends[i])
    right[inner] = forward.common(i[inner], j[inner])
    del forward
    backward = Suffixes(symbols[::-1], (n - firsts)[::-1])
    left = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > firsts[i])
    left[inner] = backward.common(n - i[inner], n - j[inner])
    length = left + period + right
    keep = length >= np.maximum(shortest, times * period)
    return np.unique(np.stack(((i - left)[keep], length[keep], period[keep]), axis=1), axis=0)


# --- stretches that can hold a run ----------------------------------------------------------------


def stretches(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Whether each word is in a stretch that a run may lie in; the texts are ``words[bounds[k]:bounds[k + 1]]``."""
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    back = np.full(n, n + 1, dtype=np.int64)
    back[order[again]] = order[again] - order[again - 1]
    marks = np.zeros(n + 1, dtype=np.int64)
    longest, reach = int(np.diff(bounds).max(initial=0)), 1
    while True:
        least = reach // 2 + 1
        need = max(shortest - least, (times - 1) * least) if reach > 1 else max(shortest - 1, times - 1)
        if need + least > longest:
            break
        near = np.zeros(n + 2, dtype=np.int8)
        near[1:-1] = back <= reach
        step = np.diff(near)
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long_ = stops - starts >= need
        starts, stops = starts[long_], stops[long_]
        np.add.at(marks, np.maximum(starts - reach, bounds[text[starts]]), 1)
        np.add.at(marks, stops, -1)
        reach *= 2
    return np.cumsum(marks[:n]) > 0


def runs_of(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Text and (start, length, period) of every run of the texts ``words[bounds[k]:bounds[k + 1]]``, by text, start and period."""
    inside = stretches(words, bounds, shortest, times)
    at = np.flatnonzero(inside)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at]
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1
    found = lyndon_runs(words[at], np.concatenate(([0], cut, [len(at)])) if len(at) else np.zeros(1, dtype=np.int64), shortest, times)
    own = text[found[:, 0]]
    found[:, 0] = at[found[:, 0]] - bounds[own]
    order = np.lexsort((found[:, 2], found[:, 0], own))
    return own[order], found[order]


def _find(batches: Iterator[pa.RecordBatch], shortest: int, times: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for block in blocks(batch.column(1)):
            raw = block.buf.tobytes()
            # split() takes the same six bytes for blanks as the words do
            texts = [raw[a:b].split() for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True)]
            numbers: dict[bytes, int] = {}
            words = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum([len(words) for words in texts])))
            own, found = runs_of(words, bounds, shortest, times)
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(drop, bounds[own] + found[:, 0] + found[:, 2], 1)
            np.add.at(drop, bounds[own] + found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(drop) == 0
            for k in np.unique(own).tolist():
                texts[k] = [w for w, stays in zip(texts[k], kept[bounds[k] : bounds[k + 1]].tolist(), strict=True) if stays]
            ptr = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, len(block)), pa.ListArray.from_arrays(pa.array(ptr), rows).cast(kind),
                    pa.array([b" ".join(words) for words in texts], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "runs", "collapsed"],
            )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed): every run by start and period, and the words that no run repeats, joined by one space.

    A word is repeated if it lies in a run after the run's first period.
    """
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return body.mapInArrow(lambda it: _find(it, shortest, times), SCHEMA)


def strongest(runs):
    """The run with the greatest length / period, compared exactly; of equals the first, then the one of the smallest period."""
    def order(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        tie = F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        return F.when(x > y, -1).when(x < y, 1).otherwise(tie)

    return F.get(F.array_sort(runs, order), F.lit(0))
