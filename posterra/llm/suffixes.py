"""Repeated passages by a sparse suffix array over content-selected positions.

A passage is ``LENGTH`` words. Of the suffixes of a text only those are kept that start
at a minimiser: the ``SEED``-word window with the smallest hash among the
``LENGTH - SEED + 1`` windows of some passage (ties: the leftmost). Equal passages pick
the same minimiser, at the same distance from their start, wherever they stand. So a
kept suffix, sorted by its seed, meets every passage equal to one of its own among its
neighbours, and a match only has to be extended left to the passage's start and right
to its end. The passages that a suffix must answer for are those whose minimiser it is,
a run of consecutive starts, and it carries the words they span.

The first pass counts seeds in a table of ``SLOTS`` slots, of one size however much is
counted. A suffix whose slot has no other is alone with its seed and is not sent; what
shares a slot by chance is sent for nothing, which only costs. The second pass deals the
others by seed. Within a task suffixes are sorted by (seed, distance, passage), neighbours
that agree are extended left and right over their words, and a match counts where the
extension covers the passage; matched passages of a text are then joined to maximal spans.
Before the exchange every block of texts settles what repeats within the block: one copy is
sent, the others are known as later ones. So a seed brings no more records to its task than
there are blocks, however many copies a passage has; and a suffix whose slot counts more
than ``HOT`` is sent passage by passage, dealt by the passage, so that a common line with
many continuations spreads over tasks. The number of tasks follows the words to be sent.

Cases: a null or empty text, or one under ``LENGTH`` words, has no passage; of equal
passages the first by (doc_id, text hash, position) is kept, the others are cut; rows
that share doc_id and text count as one document and get equal results; rows with a null
doc_id come after all others; columns other than the named ones pass through untouched,
but for those that bear the name of a result, which the result replaces; an empty table
gives no rows. Words are compared by 32-bit hashes, which for a passage is 1,600 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import slots
from .session import numbered, partitions, release
from .textblocks import Block, RangeHasher, blocks, mix

LENGTH = 50
SEED = 8
#: Slots of the table of seeds, 16 MB on the driver and in a task.
SLOTS = 1 << 24
#: Suffixes of a slot beyond which they are dealt by passage.
HOT = 1 << 12
#: Bytes of texts that are taken at a time; a longer text is taken whole.
BLOCK = 1 << 19
#: Words of suffixes that one task compares.
TASK_WORDS = 1 << 23
_NULL_ID = np.int64(np.iinfo(np.int64).max)

RESULTS = ("kept_text", "n_words", "n_repeated", "n_cut", "repeated_spans", "cut_spans")
RUN = np.dtype([("doc", "<i8"), ("fp", "<i8"), ("start", "<i4"), ("count", "<i4"), ("first", "u1")])
SUFFIX = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("fp", "<i8"), ("pos", "<i4"), ("start", "<i4"), ("count", "<i4"), ("local", "u1")])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (leftmost of equals) in every window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.where(values[right] < values[left], right, left)


def passages(block: Block, length: int, seed: int):
    """Of every passage of a block: text, first word within the text, seed hash, minimiser (within the text), hash, first word within the block."""
    words = block.words()
    hasher = RangeHasher(words.hashes(block.buf))
    at, doc = words.windows(length)
    if not len(at):
        return None
    k = np.arange(max(0, len(words) - seed + 1))
    seeds = hasher.of(k, k + seed)
    minimiser = window_minima(seeds, length - seed + 1)[at]
    first = words.ptr[doc]
    return doc, at - first, seeds[minimiser], minimiser - first, hasher.of(at, at + length), at


def _ranked(ids: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Rank of each (doc_id, text hash); equal pairs share one."""
    order = np.lexsort((fps, ids))
    new = np.concatenate(([0], (ids[order][1:] != ids[order][:-1]) | (fps[order][1:] != fps[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _runs(doc: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of maximal runs of consecutive starts with equal ``doc`` and ``first``; input sorted by (doc, start)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1])))
    edge = np.flatnonzero(new)
    return edge, np.diff(np.append(edge, len(doc)))


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (mix(seeds) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _settled(batches: Iterator[pa.RecordBatch], length: int, seed: int):
    """Of every block with a passage: runs settled within it, suffixes, the words they span."""
    for batch in batches:
        ids = batch.column(0).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(2), BLOCK):
            got = passages(block, length, seed)
            if got is not None:
                own = slice(block.first, block.first + len(block))
                yield _settle(got, ids[own], fps[own])


def _settle(got, ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of later copies; suffixes of those that speak for equal passages; the block's number of the first word of each suffix's first passage."""
    doc, start, seed, minimiser, full, at = got
    rank = _ranked(ids, fps)
    # identical passages of the block: the first by (rank, start) speaks for them all
    order = np.lexsort((start, rank[doc], full))
    same = np.concatenate(([False], full[order][1:] == full[order][:-1]))
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    lead = np.repeat(head, np.diff(np.append(head, len(order))))
    is_copy_row = (rank[doc][order] == rank[doc][order[lead]]) & (start[order] == start[order[lead]])
    shared = np.zeros(len(head), dtype=bool)
    shared[group[~is_copy_row]] = True
    speaks, local, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    speaks[order[head]] = True
    local[order[head]] = shared
    later[order[~is_copy_row]] = True
    # settled: later copies
    rows = np.flatnonzero(later)
    edge, count = _runs(doc[rows], start[rows], np.zeros(len(rows)))
    rows = rows[edge]
    run = np.zeros(len(rows), RUN)
    run["doc"], run["fp"], run["start"], run["count"] = ids[doc[rows]], fps[doc[rows]], start[rows], count
    # suffixes: runs of speaking passages with one minimiser
    s = np.flatnonzero(speaks)
    new = np.concatenate(([True], (doc[s][1:] != doc[s][:-1]) | (minimiser[s][1:] != minimiser[s][:-1]) | (start[s][1:] != start[s][:-1] + 1) | (local[s][1:] != local[s][:-1]))) if len(s) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    count = np.diff(np.append(edge, len(s)))
    lead = s[edge]
    suffix = np.zeros(len(lead), SUFFIX)
    for name, values in (("seed", seed[lead]), ("doc", ids[doc[lead]]), ("fp", fps[doc[lead]]), ("pos", minimiser[lead]), ("start", start[lead]), ("count", count), ("local", local[lead])):
        suffix[name] = values
    return run, suffix, at[lead]


def _tally(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The task's counts of suffixes by slot. A suffix that is a repeat within its block already counts twice."""
    counts = np.zeros(SLOTS, dtype=np.uint16)
    for _, suffix, _ in _settled(batches, length, seed):
        slot, n = np.unique(_slot(np.concatenate((suffix["seed"], suffix["seed"][suffix["local"] == 1]))), return_counts=True)
        counts[slot] = np.minimum(counts[slot] + n.astype(np.int64), 65535)
    if (rows := slots.packed(counts)) is not None:
        yield rows


def _grade(total: np.ndarray) -> np.ndarray:
    """0 up to one suffix, 1 to be sent, more to be sent by passage; beyond 1 it says how many there are, to a power of two."""
    return np.where(total > 1, np.maximum(1, np.log2(total + 1)), 0)


def _map(batches: Iterator[pa.RecordBatch], shared, parts: int, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One row per (block, task): runs settled within the block, suffixes, the words that these span."""
    grades = shared.value
    for batch in batches:
        ids = batch.column(0).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(2), BLOCK):
            got = passages(block, length, seed)
            if got is None:
                continue
            own = slice(block.first, block.first + len(block))
            run, suffix, at = _settle(got, ids[own], fps[own])
            grade = grades[_slot(suffix["seed"])]
            suffix, at, grade = suffix[grade > 0], at[grade > 0], grade[grade > 0]
            # of a hot slot each passage goes by itself
            hot = grade >= HOT.bit_length()
            n = np.where(hot, suffix["count"], 1)
            single = np.repeat(hot, n)
            shift = np.arange(len(single)) - np.repeat(np.cumsum(n) - n, n)
            suffix, at = np.repeat(suffix, n), np.repeat(at, n) + shift
            suffix["start"] += shift.astype(np.int32)
            suffix["count"][single] = 1
            words = (block.words().hashes(block.buf) >> np.uint64(32)).astype("<u4")
            size = suffix["count"].astype(np.int64) + (length - 1)
            upto = np.concatenate(([0], np.cumsum(size)))
            spanned = words[np.arange(upto[-1]) - np.repeat(upto[:-1] - at, size)]
            deal = mix(suffix["seed"])
            if single.any():
                alone = np.flatnonzero(single)
                whole = RangeHasher(spanned.astype(np.uint64)).of(upto[alone], upto[alone] + length)
                deal[alone] = mix(deal[alone] ^ whole)
            to_run = (mix(run["doc"].view(np.uint64) ^ run["fp"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            to_suffix = (deal % np.uint64(parts)).astype(np.int64)
            out: dict[int, list[np.ndarray]] = {}
            for values, to, i in ((run, to_run, 0), (suffix, to_suffix, 1), (spanned, np.repeat(to_suffix, size), 2)):
                if not len(to):
                    continue
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1])))
                for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
                    out.setdefault(int(to[order[a]]), [np.zeros(0, RUN), np.zeros(0, SUFFIX), np.zeros(0, "<u4")])[i] = values[order[a:b]]
            if out:
                columns = [pa.array([x[i].tobytes() for x in out.values()], pa.binary()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), dtype=np.int32)), *columns], names=["part", "runs", "suffixes", "words"])


def _reduce(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sort a task's suffixes, extend matches of neighbours, return runs of repeated passages."""
    runs, suffixes, words = [], [], []
    for batch in batches:
        for kind, dtype, to in (("runs", RUN, runs), ("suffixes", SUFFIX, suffixes), ("words", "<u4", words)):
            to += [np.frombuffer(x, dtype=dtype) for x in batch.column(batch.schema.get_field_index(kind)).to_pylist()]
    run = np.concatenate(runs) if runs else np.zeros(0, RUN)
    suffix = np.concatenate(suffixes) if suffixes else np.zeros(0, SUFFIX)
    word = np.concatenate(words) if words else np.zeros(0, "<u4")
    del runs, suffixes, words
    yield from _sent(run)
    if len(suffix):
        yield from _sent(_compare(suffix, word, length))


def extended(words: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether the matches of the seeds at words x and y reach ``left`` words to the left and ``right`` to the right."""
    out = np.zeros(len(x), dtype=bool)
    size = left + right
    upto = np.concatenate(([0], np.cumsum(size)))
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + step, side="right")) - 1)
        shift = np.arange(upto[b] - upto[a]) - np.repeat(upto[a:b] - upto[a] + left[a:b], size[a:b])
        same = words[np.repeat(x[a:b], size[a:b]) + shift] == words[np.repeat(y[a:b], size[a:b]) + shift]
        out[a:b] = np.add.reduceat(same, upto[a:b] - upto[a]) == size[a:b]
        a = b
    return out


def _compare(suffix: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    size = suffix["count"].astype(np.int64) + (length - 1)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(suffix)), suffix["count"])
    within = np.arange(len(owner)) - np.repeat(np.cumsum(suffix["count"]) - suffix["count"], suffix["count"])
    start = suffix["start"][owner] + within
    distance = suffix["pos"][owner] - start
    rank = _ranked(suffix["doc"], suffix["fp"])
    first_word = base[owner] + within
    full = RangeHasher(words.astype(np.uint64)).of(first_word, first_word + length)
    key = mix(suffix["seed"][owner] ^ mix(full)) + distance.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    follows = np.append(same[1:], False)
    # only groups of two and more matter from here
    rows = order[same | follows]
    lone_local = order[~(same | follows)]
    lone_local = lone_local[suffix["local"][owner[lone_local]] == 1]
    by = np.lexsort((start[rows], rank[owner[rows]], key[rows]))
    rows = rows[by]
    head = np.concatenate(([True], key[rows][1:] != key[rows][:-1])) if len(rows) else np.zeros(0, bool)
    # a row goes with its neighbour above if the match of their seeds extends over the whole passage
    below = np.flatnonzero(~head)
    if len(below):
        x, y = rows[below], rows[below - 1]
        head[below] = ~extended(words, first_word[x] + distance[x], first_word[y] + distance[y], distance[x], length - distance[x])
    lead = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))] if len(rows) else rows
    as_first = (rank[owner[rows]] == rank[owner[lead]]) & (start[rows] == start[lead])
    # a group of equal rows of one document alone is no repeat unless its block found one
    number = np.cumsum(head) - 1
    real = np.zeros(number[-1] + 1 if len(number) else 0, dtype=bool)
    real[number[~as_first]] = True
    real[number[suffix["local"][owner[rows]] == 1]] = True
    ok = real[number] if len(number) else np.zeros(0, bool)
    rows, as_first = rows[ok], as_first[ok]
    rows = np.concatenate((rows, lone_local))
    as_first = np.concatenate((as_first, np.ones(len(lone_local), dtype=bool)))
    by = np.lexsort((start[rows], rank[owner[rows]]))
    rows, as_first = rows[by], as_first[by]
    keep = np.concatenate(([True], (rank[owner[rows]][1:] != rank[owner[rows]][:-1]) | (start[rows][1:] != start[rows][:-1]))) if len(rows) else np.zeros(0, bool)
    rows, as_first = rows[keep], as_first[keep]
    edge, count = _runs(rank[owner[rows]], start[rows], as_first)
    rows, as_first = rows[edge], as_first[edge]
    out = np.zeros(len(rows), RUN)
    out["doc"], out["fp"], out["start"], out["count"], out["first"] = suffix["doc"][owner[rows]], suffix["fp"][owner[rows]], start[rows], count, as_first
    return out


def _sent(run: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs by document: many runs of a document within a task become one row."""
    if not len(run):
        return
    run = run[np.lexsort((run["start"], run["fp"], run["doc"]))]
    new = np.concatenate(([True], (run["doc"][1:] != run["doc"][:-1]) | (run["fp"][1:] != run["fp"][:-1])))
    edge = np.flatnonzero(new)
    offsets = np.append(edge, len(run)).astype(np.int32)
    code = (run["start"].astype(np.int64) << 32) | (run["count"].astype(np.int64) << 1) | run["first"]
    for a in range(0, len(edge), 20000):
        b = min(a + 20000, len(edge))
        cut = offsets[a : b + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(run["doc"][edge[a:b]]), pa.array(run["fp"][edge[a:b]]), pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(code[cut[0] : cut[-1]]))],
            names=["doc", "fp", "runs"],
        )


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, fp, runs): for each document with a repeated passage, its runs of passage starts.

    ``fp`` is ``xxhash64`` of the text. A run is ``start << 32 | count << 1 | first`` in
    words; ``first`` says that this is the occurrence to keep.
    """
    if not 1 <= seed <= length:
        raise ValueError("seed must lie between 1 and length")
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("fp"), body.alias("text")).where(F.col("text").isNotNull())
    grades = slots.gathered(rows.mapInArrow(lambda it: _tally(it, length, seed), "chunk int, packed binary"), SLOTS, "u2", _grade)
    release(spark)
    shared = spark.sparkContext.broadcast(grades)
    # a grade g stands for fewer than 2 ** (g + 1) suffixes of about one and a half passages
    n = sum(int(slots_at) << (grade + 1) for grade, slots_at in enumerate(np.bincount(grades)) if grade)
    parts = max(partitions(spark), -(-n * 3 * length // (2 * TASK_WORDS)))
    # four numbers a task, so that tasks get about as many however the numbers are hashed
    dealt = rows.mapInArrow(lambda it: _map(it, shared, 4 * parts, length, seed), "part int, runs binary, suffixes binary, words binary").repartition(parts, "part")
    found = dealt.mapInArrow(lambda it: _reduce(it, length), "doc long, fp long, runs array<long>")
    return found.groupBy("doc", "fp").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def spans(runs: list[np.ndarray], n_words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word masks: in a repeated passage; in one that is a later occurrence."""
    any_, later = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
    start, count, first = runs >> 32, (runs >> 1) & 0x7FFFFFFF, runs & 1
    end = start + count - 1 + length
    np.add.at(any_, start, 1)
    np.add.at(any_, end, -1)
    np.add.at(later, start[first == 0], 1)
    np.add.at(later, end[first == 0], -1)
    return np.cumsum(any_)[:n_words] > 0, np.cumsum(later)[:n_words] > 0


def _edges(mask: np.ndarray) -> str:
    step = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return ",".join(f"{a}:{b}" for a, b in zip(step[::2], step[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        found = batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column(batch.num_columns - 2)
        new, counts = [None] * n, np.zeros((3, n), dtype=np.int64)
        where = [["", ""] for _ in range(n)]
        for block in blocks(texts):
            words = block.words()
            for i in range(len(block)):
                row = block.first + i
                a, b = words.ptr[i], words.ptr[i + 1]
                counts[0, row] = b - a
                if not block.valid[i]:
                    continue
                if not found[row]:
                    new[row] = texts[row].as_py()
                    continue
                repeated, later = spans(np.array(found[row], dtype=np.int64), b - a, length)
                counts[1, row], counts[2, row] = repeated.sum(), later.sum()
                where[row] = [_edges(repeated), _edges(later)]
                new[row] = _without(block, words.starts[a:b], words.ends[a:b], later, i)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(new, pa.string()), *(pa.array(c) for c in counts), *(pa.array([w[j] for w in where], pa.string()) for j in (0, 1))],
            names=[*batch.schema.names[:-2], *RESULTS],
        )


def _without(block: Block, starts: np.ndarray, ends: np.ndarray, later: np.ndarray, i: int) -> str:
    """The text without its later words; a cut span goes with the white space after it."""
    keep = np.ones(block.offs[i + 1] - block.offs[i], dtype=bool)
    step = np.flatnonzero(np.diff(np.concatenate(([0], later.astype(np.int8), [0]))))
    for a, b in zip(step[::2], step[1::2], strict=True):
        stop = starts[b] if b < len(starts) else block.offs[i + 1]
        keep[starts[a] - block.offs[i] : stop - block.offs[i]] = False
    return block.buf[block.offs[i] : block.offs[i + 1]][keep].tobytes().decode("utf-8", "replace")


def _cut_rows(docs: DataFrame, key: str, text: str, length: int, seed: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1 and so on, and the results."""
    rows, (key, text) = numbered(docs, key, text)
    runs = repeated_runs(rows, key, text, length, seed)
    body = F.col(text).cast("string")
    keyed = rows.select("*", F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("__doc"), F.xxhash64(body).alias("__fp"), body.alias("__text"))
    joined = keyed.join(runs.select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp"), F.col("runs").alias("__runs")), ["__doc", "__fp"], "left")
    joined = joined.select(*rows.columns, "__text", "__runs")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return joined.mapInArrow(lambda it: _cut(it, length), f"{kinds}, kept_text string, n_words long, n_repeated long, n_cut long, repeated_spans string, cut_spans string")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` that bear no result's name, then kept_text, n_words, n_repeated, n_cut and both span lists (word numbers)."""
    rows = _cut_rows(docs, key, text, length, seed)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULTS], *RESULTS)


def first_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with later passages cut from ``text``; rows that are left without a word go, rows that had none stay."""
    rows = _cut_rows(docs, key, text, length, seed).where((F.col("n_cut") == 0) | (F.col("n_cut") < F.col("n_words")))
    return rows.select(*[(F.col("kept_text") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
