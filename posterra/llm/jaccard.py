"""Exact Jaccard self-join of texts on word shingles, by prefixes under several global orders.

The set of a text is its distinct ``SHINGLE``-word shingles. Under a global order of all
shingles the prefix of a set of ``n`` is its first ``n - ceil(0.8 n) + 1`` shingles, and two
sets of Jaccard similarity 0.8 or more share a shingle of their prefixes, whatever the order.
Under the first order prefixes are longer by ``s - 1``, and then share ``s`` shingles at
least; a set of which fewer are listed with any other set has no partner and goes at once.
There are ``ORDERS`` orders. All put shingles that many texts hold last (by levels of a
count table of fixed size, which every task adds to and every task gets), so that a passage
that thousands share stands in a prefix only where little else does; within a level each
order is another hash. A pair is a candidate if its prefixes meet under the first order
(posting lists) *and* under every other (arrays of the two sets); then
sizes and parity bitmaps, which differ in at most as many bits as the sets in shingles, must allow it. No
filter loses a link.

Candidates are verified on the whole sets: 64-bit shingle hashes, integer comparison
``100 * common >= percent * union``; only sets that may have a partner are kept. Equal sets are
one class, found by a 128-bit fingerprint before anything else, so copies are never paired.
A list's leader is the member whose lists are largest in
sum, for a family of near copies the text they were copied from; each set is compared first
with the leader it shares most lists with, which brings most of a family into one component
at one comparison a member. Members of a list that are then still in different components
are compared in blocks of at most ``BLOCK`` by ``BLOCK`` that spread over tasks: first the
``BEST`` likeliest pairs of each component, which merges what can be merged, then every
pair of different components that the filters allow. No list is limited and no such pair is
left out.

Cases: a null or empty text has no shingle, no link, and is its own component; a text
under ``SHINGLE`` words is one shingle; equal rows are in one class; rows sharing a key
are judged row by row, each by its own set; a row with a null key links like any other but
names no component, so the component of rows that all lack a key is null; columns other than the named
ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import slots
from .session import checkpointed, numbered, partitions, release
from .textblocks import ASCII_LOWER, Block, RangeHasher, blocks, mix

SHINGLE = 5
PERCENT = 80
ORDERS = 3
BITMAP_WORDS = 16
BLOCK = 1024
BEST = 3
#: Shingles and sets that one verification task compares with one leader.
TASK_SHINGLES = 400_000
TASK_SETS = 256
#: Slots of the count table behind the orders: 4 MB however much was counted.
SLOTS = 1 << 22

_SALTS = np.random.default_rng(577215664).integers(1, 1 << 63, ORDERS, dtype=np.uint64)


def by_text(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by text, then value."""
    order = np.argsort(values)
    return order[np.argsort(doc[order].astype(np.uint16 if doc.max(initial=0) < 1 << 16 else np.int64), kind="stable")]


def shingle_sets(block: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's texts, sorted by text then hash, and the offsets of the texts."""
    low = Block(block.first, ASCII_LOWER[block.buf], block.offs, block.valid)
    words = low.words()
    hasher = RangeHasher(words.hashes(low.buf))
    at, doc = words.windows(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    codes = np.concatenate((hasher.of(at, at + k), hasher.of(words.ptr[short], words.ptr[short + 1])))
    doc = np.concatenate((doc, short))
    order = by_text(codes, doc)
    codes, doc = codes[order], doc[order]
    new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1]))) if len(codes) else np.zeros(0, bool)
    return codes[new], np.searchsorted(doc[new], np.arange(len(block) + 1))


def fingerprints(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        upto = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes ^ np.uint64(salt)), out=upto[1:])
        out.append((upto[offs[1:]] - upto[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def class_ids(codes: np.ndarray, offs: np.ndarray, shared: np.ndarray | None = None, bits: int = 64) -> np.ndarray:
    """A number for each set, of its size and fingerprint.

    ``shared`` lists the numbers that different sets have in common, in order: those sets get another one.
    ``bits`` is there for tests, which can't wait for such sets.
    """
    hi, lo = fingerprints(codes, offs)
    return numbered_classes(hi, lo, np.diff(offs), shared, bits)


def numbered_classes(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, shared: np.ndarray | None = None, bits: int = 64) -> np.ndarray:
    own = mix(hi.view(np.uint64) + mix(lo.view(np.uint64) + n.astype(np.uint64)))
    ids = (own >> np.uint64(64 - bits)).view(np.int64)
    if shared is not None and len(shared):
        other = mix(lo.view(np.uint64) + mix(hi.view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03) + n.astype(np.uint64)))
        at = np.minimum(np.searchsorted(shared, ids), len(shared) - 1)
        ids = np.where(shared[at] == ids, other.view(np.int64), ids)
    return ids


def shared_prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that the first-order prefixes of a set of ``n`` and of any that links with it share at least: their prefixes are that much longer, less one."""
    return np.maximum(1, n * (100 - percent) // 160)


def prefix_length(n: np.ndarray, percent: int = PERCENT, shared: np.ndarray | int = 1) -> np.ndarray:
    """Shingles of a set of ``n`` of which ``shared`` at least are in the like of every set it links with, under any order."""
    return np.where(n > 0, np.minimum(n, n - -(-percent * n // 100) + shared), 0)


def prefixes(codes: np.ndarray, offs: np.ndarray, order: int, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of every set under one order, and the offsets of the sets."""
    level = levels[codes >> np.uint64(64 - SLOTS.bit_length() + 1)].astype(np.uint64)
    rank = (level << np.uint64(58)) | (mix(codes ^ _SALTS[order]) >> np.uint64(6))
    n = np.diff(offs)
    by = by_text(rank, np.repeat(np.arange(len(n)), n))
    length = prefix_length(n, percent, 1 if order else shared_prefix(n, percent))
    upto = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(upto[-1]) - np.repeat(upto[:-1] - offs[:-1], length)
    return codes[by[at]], upto


def bitmaps(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Parity bitmap of each set."""
    n, bits = len(offs) - 1, 64 * BITMAP_WORDS
    doc = np.repeat(np.arange(n), np.diff(offs))
    parity = np.bincount(doc * bits + (codes % np.uint64(bits)).astype(np.int64), minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, bits), axis=1).view(np.int64)


# --- passes over the texts ----------------------------------------------------------------------

_MARKED = "doc_id long, th long, n long, hi long, lo long, id long, chunk int, packed binary"


def _mark(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and class of every text; then, in rows of their own, the task's counts of shingles by slot."""
    counts = np.zeros(SLOTS, dtype=np.uint32)
    for batch in batches:
        for block in blocks(batch.column(1)):
            codes, offs = shingle_sets(block)
            hi, lo = fingerprints(codes, offs)
            slot, count = np.unique((codes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), return_counts=True)
            counts[slot] += count.astype(np.uint32)
            n = len(block)
            own = [batch.column(i).slice(block.first, n) for i in (0, 2)]
            numbers = [pa.array(x) for x in (np.diff(offs).astype(np.int64), hi, lo, numbered_classes(hi, lo, np.diff(offs), bits=bits))]
            yield pa.RecordBatch.from_arrays([*own, *numbers, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=[x.split()[0] for x in _MARKED.split(", ")])
    if (rows := slots.packed(counts)) is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int64())] * 6 + rows.columns, names=[x.split()[0] for x in _MARKED.split(", ")])


def _level(usual: float):
    """Sums of slots as levels: 0 up to what is usual by chance, one more for each doubling beyond."""
    return lambda total: np.log2(np.maximum(total / (usual + 4 * usual**0.5 + 4), 1))


def _renumbered(batches: Iterator[pa.RecordBatch], shared: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Marked rows with the ids that sets get whose first is shared."""
    for batch in batches:
        hi, lo, n = (batch.column(i).to_numpy() for i in (3, 4, 2))
        yield batch.set_column(5, "id", pa.array(numbered_classes(hi, lo, n, shared, bits)))


def _unseen(codes: np.ndarray, offs: np.ndarray, seen: set[int], common: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those sets of a block that are not empty and whose class the task has not met: codes, offsets, classes."""
    ids, n = class_ids(codes, offs, common, bits), np.diff(offs)
    new = np.array([k > 0 and not (name in seen or seen.add(name)) for name, k in zip(ids.tolist(), n.tolist(), strict=True)], dtype=bool)
    return codes[np.repeat(new, n)], np.concatenate(([0], np.cumsum(n[new]))), ids[new]


def _heads(batch: pa.RecordBatch, heads: np.ndarray) -> pa.Array:
    """The texts of a batch of (name, text) that stand for their class, and few others."""
    return batch.column(1).filter(pa.array(slots.may_hold(heads, batch.column(0).to_numpy())))


def _post(batches: Iterator[pa.RecordBatch], shared, percent: int) -> Iterator[pa.RecordBatch]:
    """(k, id): the first-order prefix of every class that the task meets a head of, once.

    With a filter of the lists that several texts are in: the plain prefix of those classes
    alone that have enough of the longer one in such lists.
    """
    (levels, heads, lists), common, bits = shared.value
    seen: set[int] = set()
    for batch in batches:
        for block in blocks(_heads(batch, heads)):
            codes, offs, ids = _unseen(*shingle_sets(block), seen, common, bits)
            keys, upto = prefixes(codes, offs, 0, levels, percent)
            size = np.diff(upto)
            of = np.repeat(ids, size)
            if lists is not None and len(keys):
                able = slots.may_hold(lists, keys)
                n = np.diff(offs)
                # any set that links with one of n has four fifths of n, and shares what that one's prefix must share
                enough = np.diff(np.concatenate(([0], np.cumsum(able)))[upto]) >= shared_prefix(n * percent // 100, percent)
                able &= np.repeat(enough, size) & (np.arange(len(keys)) - np.repeat(upto[:-1], size) < np.repeat(prefix_length(n, percent), size))
                keys, of = keys[able], of[able]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of)], names=["k", "id"])


_SETS = "id long, n long, codes binary, bitmap array<long>, prefix2 array<int>, prefix3 array<int>"


def _sets(batches: Iterator[pa.RecordBatch], shared, percent: int) -> Iterator[pa.RecordBatch]:
    """Set, bitmap and prefixes under the other orders of every class that the filter lets through, once a task; 32 bits of each shingle of the prefixes, which can only add candidates."""
    (levels, heads, wanted), common, bits = shared.value
    seen: set[int] = set()
    for batch in batches:
        for block in blocks(_heads(batch, heads)):
            codes, offs, ids = _unseen(*shingle_sets(block), seen, common, bits)
            able = slots.may_hold(wanted, ids)
            n = np.diff(offs)
            codes, offs, ids = codes[np.repeat(able, n)], np.concatenate(([0], np.cumsum(n[able]))), ids[able]
            if len(ids):
                lists = [(bitmaps(codes, offs).reshape(-1), np.arange(len(ids) + 1) * BITMAP_WORDS)]
                for o in range(1, ORDERS):
                    keys, upto = prefixes(codes, offs, o, levels, percent)
                    lists.append((keys.astype(np.uint32).view(np.int32), upto))
                columns = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values)) for values, upto in lists]
                whole = pa.array([codes[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offs)), whole, *columns], names=[x.split()[0] for x in _SETS.split(", ")])


# --- verification -------------------------------------------------------------------------------


def _verify(percent: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        leader = int(group["leader"].iloc[0])
        group = group.drop_duplicates("member")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["codes"]]
        own = group["member"].to_numpy() == leader
        base = sets[int(np.flatnonzero(own)[0])]
        keep = []
        others = np.flatnonzero(~own)
        if len(others):
            size = np.array([len(sets[i]) for i in others])
            all_ = np.concatenate([sets[i] for i in others])
            at = np.minimum(np.searchsorted(base, all_), max(0, len(base) - 1))
            common = np.add.reduceat((base[at] == all_).astype(np.int64), np.cumsum(size) - size)
            keep = others[100 * common >= percent * (size + len(base) - common)]
        return pd.DataFrame({"a": np.full(len(keep), leader, dtype=np.int64), "b": group["member"].to_numpy()[keep] if len(keep) else np.zeros(0, np.int64)})

    return compare


def _near(a: str, b: str):
    """Number of bits in which two bitmaps differ; linked sets differ in at least as many shingles."""
    words = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITMAP_WORDS)]
    return sum(words[1:], words[0])


def plausible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b, nb) of ``pairs`` that meet under every other order too and that sizes and bitmaps allow."""
    others = [f"prefix{o}" for o in range(2, ORDERS + 1)]
    side = lambda name: sets.select(F.col("id").alias(name), *[F.col(x).alias(f"{x}_{name}") for x in ("n", "bitmap", *others)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    able = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * _near("bitmap_a", "bitmap_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    for p in others:
        able &= F.arrays_overlap(f"{p}_a", f"{p}_b")
    return both.where(able).select("a", "b", F.col("n_b").alias("nb"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, nb) whose sets link."""
    shares = pairs.groupBy("a").agg(F.greatest(F.ceil(F.sum("nb") / TASK_SHINGLES), F.ceil(F.count(F.lit(1)) / TASK_SETS)).cast("int").alias("parts"))
    members = pairs.join(shares, "a").select(F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("b").alias("id"))
    leaders = shares.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = members.unionByName(leaders).join(sets.select("id", "codes"), "id").select("leader", "part", F.col("id").alias("member"), "codes")
    return rows.groupBy("leader", "part").applyInPandas(_verify(percent), "a long, b long")


# --- components ---------------------------------------------------------------------------------


def _roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest of (node, up), each node with one ``up``; roots are not listed."""
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        moved = checkpointed(parents.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")))
        parents = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return parents.withColumnRenamed("up", "component")


def _merged(part: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links between nodes of different components; nodes not listed are their own."""
    of = lambda side: part.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    joined = checkpointed(connected_components(between, few=0))
    renamed = part.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    # a component's own name may be no node of ``part``
    return checkpointed(renamed.unionByName(joined.join(part, "node", "left_anti")))


def _across(batches: Iterator[pa.RecordBatch], percent: int, best: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block pair that lie in different components and that sizes and bitmaps allow.

    With ``best`` only that many pairs a component, those with the fewest differing bits for their size.
    """
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    t = pa.concat_tables(tables)
    task, side, id_, c, n = (t.column(i).to_numpy() for i in range(5))
    maps = t.column(5).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_WORDS)
    order = np.lexsort((id_, c, task))
    task, side, id_, c, n, maps = task[order], side[order], id_[order], c[order], n[order], maps[order]
    # a row meets those of its task that stand after its own component
    end = np.searchsorted(task, task, side="right")
    runs = np.append(np.flatnonzero((task[1:] != task[:-1]) | (c[1:] != c[:-1])) + 1, len(task))
    after = np.repeat(runs, np.diff(np.concatenate(([0], runs))))
    ahead = end - after
    upto = np.concatenate(([0], np.cumsum(ahead)))
    found: list[tuple[np.ndarray, ...]] = []
    row = 0
    while row < len(task):
        last = max(row + 1, int(np.searchsorted(upto, upto[row] + (1 << 20), side="right")) - 1)
        x = np.repeat(np.arange(row, last), ahead[row:last])
        y = np.arange(len(x)) - np.repeat(upto[row:last] - upto[row], ahead[row:last]) + after[x]
        ok = ((side[x] < 0) | (side[x] != side[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        bits = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
        ok = (100 + percent) * bits <= (100 - percent) * (n[x] + n[y])
        found.append((x[ok], y[ok], bits[ok]))
        row = last
    x, y, bits = (np.concatenate([f[i] for f in found]) for i in range(3))
    if best and len(x):
        score = np.concatenate((bits / (n[x] + n[y]), bits / (n[x] + n[y])))
        own, pair = np.concatenate((c[x], c[y])), np.concatenate((np.arange(len(x)), np.arange(len(x))))
        order = np.lexsort((pair, score, own))
        head = np.concatenate(([True], own[order][1:] != own[order][:-1]))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        keep = np.unique(pair[order[rank < best]])
        x, y, bits = x[keep], y[keep], bits[keep]
    low, high = np.minimum(id_[x], id_[y]), np.maximum(id_[x], id_[y])
    if len(low):
        order = np.lexsort((high, low))
        new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
        keep = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(high[keep])], names=["a", "b"])


def across_components(posted: DataFrame, sets: DataFrame, part: DataFrame, percent: int, best: int) -> DataFrame:
    """(a, b): pairs of members of one list in different components, as ``_across`` finds them."""
    labelled = posted.select("k", "id").join(part.withColumnRenamed("node", "id"), "id", "left").select("k", "id", F.coalesce("component", "id").alias("c"))
    open_ = labelled.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("least <> most").select("k", "blocks")
    rows = labelled.join(open_, "k").join(sets.select("id", "n", "bitmap"), "id")
    # member of block b meets the blocks from 0: pairs (min, max) of block numbers are tasks
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    rows = rows.select(task.alias("task"), side.alias("side"), "id", "c", "n", "bitmap")
    dealt = rows.repartition(partitions(posted.sparkSession), "task")
    return dealt.mapInArrow(lambda it: _across(it, percent, best), "a long, b long").distinct()


def _head():
    """The first row of a group by (key, text hash); rows without a key come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("loose"), "doc_id", "th")).alias("head")


def _shared(rows: DataFrame) -> DataFrame:
    """Ids that sets of different fingerprint or size have in common."""
    print_ = F.struct("hi", "lo", "n")
    return rows.where("n > 0").groupBy("id").agg(F.min(print_).alias("least"), F.max(print_).alias("most")).where("least <> most").select("id")


def linked_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, id) of every row (th: ``xxhash64`` of the text), and (id, component, component_id) of every class of equal sets.

    ``component_id`` is the least key in the component, null if there is none; ``component`` tells those apart.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    body = body.select("doc_id", "text", F.xxhash64("text").alias("th"))
    marked = checkpointed(body.mapInArrow(lambda it: _mark(it, bits), _MARKED))
    rows = marked.where("chunk is null").drop("chunk", "packed")
    # different sets that share 64 bits (in a corpus of n sets, n^2 / 2^65 pairs) are told apart by the other 64 and their size
    common = np.array([], dtype=np.int64)
    if shared_ids := [r["id"] for r in _shared(rows).collect()]:
        common = np.sort(np.array(shared_ids, dtype=np.int64))
        rows = checkpointed(rows.mapInArrow(lambda it: _renumbered(it, common, bits), "doc_id long, th long, n long, hi long, lo long, id long"))
        if not _shared(rows).isEmpty():
            raise RuntimeError("different sets share 128 bits")
    usual = (rows.agg(F.sum("n")).first()[0] or 0) / SLOTS
    levels = slots.gathered(marked.where("chunk is not null").select("chunk", "packed"), SLOTS, "u4", _level(usual))
    # the tasks' counts, a few MB each, go with the marked rows
    rows = checkpointed(rows.select("doc_id", "th", "n", "id"))
    del marked
    release(spark)
    classes = checkpointed(rows.where("n > 0").groupBy("id").agg(_head()).select("id", "head.doc_id", "head.th"))
    # of a class one text is worked on, however many copies lie in however many tasks: lists would count copies, and shuffles carry them
    name = F.xxhash64("doc_id", "th")
    heads = slots.key_filter(classes.select(name.alias("name")))
    classes = classes.select("id", "doc_id")
    share = lambda table: spark.sparkContext.broadcast(((levels, heads, table), common, bits))

    texts = body.select(name.alias("name"), "text")
    posts = lambda tables: texts.mapInArrow(lambda it: _post(it, tables, percent), "k long, id long")
    several = checkpointed(posts(share(None)).groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k"))
    release(spark)
    lists = share(slots.key_filter(several))
    del several
    release(spark)
    # a class may still be posted twice: that a list has one class only is seen once those are one
    posted = checkpointed(posts(lists).distinct())
    release(spark)
    posted = posted.join(posted.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "k")
    posted = checkpointed(posted.join(posted.groupBy("id").agg(F.sum("size").alias("weight")), "id").select("k", "id", "weight"))
    release(spark)
    wanted = checkpointed(posted.select("id").distinct())
    found = texts.mapInArrow(lambda it, tables=share(slots.key_filter(wanted)): _sets(it, tables, percent), _SETS).join(wanted, "id")
    sets = checkpointed(found.groupBy("id").agg(*[F.first(x.split()[0]).alias(x.split()[0]) for x in _SETS.split(", ")[1:]]))
    release(spark)

    leads = posted.groupBy("k").agg(F.max_by("id", F.struct("weight", "id")).alias("lead"))
    best = posted.select("k", "id").join(leads, "k").where("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = best.groupBy("id").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    tried = checkpointed(plausible(best.select(F.col("lead").alias("a"), F.col("id").alias("b")), sets, percent))
    del best, leads
    release(spark)
    # weights grow from a set to its leader, so these links are a forest
    links = checkpointed(verified(tried, sets, percent).select(F.col("b").alias("node"), F.col("a").alias("up")))
    release(spark)
    part = _roots(links)
    del links
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for most in (BEST, 0):
        release(spark)
        cross = checkpointed(plausible(across_components(posted, sets, part, percent, most).join(tried, ["a", "b"], "left_anti"), sets, percent))
        if cross.isEmpty():
            continue
        release(spark)
        links = checkpointed(verified(cross, sets, percent))
        release(spark)
        part = _merged(part, links)
        tried = tried.unionByName(cross.select("a", "b"))
    release(spark)
    found = classes.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows, found.join(least, "component").select("id", "component", "component_id")


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, classes = linked_classes(docs, key, text, percent, bits)
    rows = rows.withColumn("id", F.when(F.col("n") > 0, F.col("id")))
    return rows.join(classes, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first by (key, text hash), once, null keys last; rows without a shingle stay, equal ones once."""
    rows, classes = linked_classes(docs, key, text, percent)
    first = rows.where("n > 0").join(classes, "id").groupBy("component").agg(_head()).select("head.doc_id", "head.th")
    alone = rows.where("n = 0").select("doc_id", "th")
    stay = checkpointed(first.unionByName(alone).distinct())
    del rows, classes, first, alone
    release(docs.sparkSession)
    plain, (key, text) = numbered(docs, key, text)
    # keys without nulls, so that rows are dealt once for the join and for what is left of equal ones
    names = lambda doc, th: {"__no": doc.isNull(), "__doc": F.coalesce(doc, F.lit(0).cast("long")), "__th": th}
    stay = stay.select(*[c.alias(n) for n, c in names(F.col("doc_id"), F.col("th")).items()])
    keyed = plain.withColumns(names(F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string"))))
    own = ["__no", "__doc", "__th"]
    return keyed.join(stay, own, "left_semi").dropDuplicates(own).select(*plain.columns).toDF(*docs.columns)
