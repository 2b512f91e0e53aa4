"""Connected components of an edge list, without gathering it anywhere.

Rounds alternate between linking each node's larger neighbours and its smaller ones to the
smallest node seen, until the edges are stars around the smallest node of their component.
The number of rounds grows with the logarithm of the longest chain; before the first, every
task joins what its own edges tie together, a piece at a time. Minima are summed
within tasks first and joins are plain equi-joins, so a hot node is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, release
from . import prefix


#: Edges that a task joins at a time before the first round; so many or fewer need no round.
PIECE = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to edges from each node to the smallest that the same piece of edges ties it to."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            yield _star(kept)
            kept, size = [], 0
    if size:
        yield _star(kept)


def _least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each is tied to by edges (u, v)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        # the roots of both ends go below the smaller one, and every number to its root's root
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while not np.array_equal(up := label[label], label):
            label = up
        left = label[u] != label[v]
        if not left.any():
            return label
        u, v = u[left], v[left]


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(2)]
    coded = pa.concat_arrays(ends).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    number = rank[coded.indices.to_numpy()]
    root = _least_reachable(number[: len(ends[0])], number[len(ends[0]) :], len(order))
    moved = np.flatnonzero(root != np.arange(len(order)))
    nodes = coded.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], names=["u", "v"])


def _settled(e: DataFrame, most_rounds: int) -> DataFrame:
    """Edges (u, v), u > v, to stars around the smallest node of each component."""
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = PIECE) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Once there are ``few`` edges or fewer, which a piece holds, one task joins them; more are settled in rounds.
    """
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    kind = pairs.schema["u"].dataType.simpleString()
    e = checkpointed(pairs.mapInArrow(_stars, f"u {kind}, v {kind}").distinct())
    if few and e.count() <= min(few, PIECE):
        # so few edges are one piece
        e = checkpointed(e.coalesce(1).mapInArrow(_stars, f"u {kind}, v {kind}"))
    else:
        e = _settled(e, most_rounds)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    found = stars.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def fragment_components(weights: DataFrame, tgroups: DataFrame) -> DataFrame:
    """Components of the transcript-fragment graph, where transcripts of one tgroup hang together.

    weights: (sample, tid, frag); tgroups: (tid, tgroup). Returns (sample, tid, component) with
    components numbered from 0 by their smallest transcript. A null fragment ties nothing.

    A tgroup is one node, so that only fragments of several tgroups are edges; a transcript without a tgroup is a node of its own.
    """
    group = F.coalesce(F.col("tgroup").cast("int"), -1 - F.col("tid"))
    node = F.shiftleft(F.col("sample").cast("long"), 33) + F.col("group")
    of = tgroups.select(F.col("tid").cast("int").alias("tid"), "tgroup")
    placed = weights.select(F.col("sample").cast("int").alias("sample"), F.col("tid").cast("int").alias("tid"), "frag").join(of, "tid", "left").select("sample", "tid", "frag", group.alias("group"))
    ends = placed.where("frag is not null").groupBy("sample", "frag").agg(F.min("group").alias("least"), F.max("group").alias("most"))
    several = checkpointed(ends.where("least < most").select("sample", "frag", F.col("least").alias("root")))
    release(weights.sparkSession)
    members = placed.select("sample", "tid", "group", node.alias("node")).distinct()
    if several.isEmpty():
        rows = members.withColumn("component", F.col("node"))
    else:
        edges = placed.join(several, ["sample", "frag"]).where("group <> root").select(node.alias("a"), (node - F.col("group") + F.col("root")).alias("b"))
        rows = members.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
        release(weights.sparkSession)
    first = rows.groupBy("sample", "component").agg(F.min("tid").alias("least"))
    number = prefix.ranked(first, ["least"], "number", keys=["sample"]).select("component", F.col("number").cast("int").alias("number"))
    release(weights.sparkSession)
    # of a transcript in several tgroups one row
    return rows.select("sample", "tid", "component").distinct().join(number, "component").select("sample", "tid", F.col("number").alias("component"))
