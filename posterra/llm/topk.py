"""Exact top-k inner product search with a pair of cover trees.

The top of the data's tree is common to all tasks: up to ``CELLS`` net points, chosen
farthest first from a sample of at most ``SAMPLE`` rows, and every row belongs to the
nearest, with its true distance. Cells are cut by a hash into blocks of about ``BLOCK``
rows. Queries are indexed by the same net. First every query searches its own cell, which
gives it a k-th score. Then it goes to those other cells alone that can beat it: over all
points p of a cell with centre c and radius r

    q.p <= q.c + r |q|

and cells that no query of a group reaches are not sent to it. Within a task the pair of
trees goes on below the net: a node holds a centre (one of its points), the true distance
to its farthest point, and children around net points; queries are indexed the same way,
and the pair of roots is descended together, most promising pair first. Over all queries q
and points p below two nodes

    q.p <= cq.cp + rq |cp| + rp |cq| + rq rp

so a pair is dropped when that bound is under the worst k-th score of the query node. Two
leaves are compared by one exact matrix product. Where the points have no structure, as
noise in many dimensions, radii hardly shrink, no bound prunes, a node stays a leaf, and
the search costs what the plain product of two blocks costs (``reached`` gives the share of
cells that queries go to). The k best of each block then meet in a ranking by query, which
sees at most k rows a block.

Components are ``floor(1024 * x)`` as integers; a vector that is null, or holds a null, a
NaN or an infinity, takes no part. Shorter vectors are compared as if padded with zeros.
Rows that share a key are one item stated several times: none is a candidate for a query of
that key, each counts as a candidate for all others, and query rows of one key with
different vectors are queries of their own, each with its ranks; equal query rows are one.
Ties go to the smaller key. Rows with a null key take no part. Scores beyond 64 bits are
clipped. Columns other than the named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

BLOCK = 8192
QUERY_BLOCK = 4096
CELLS = 64
SAMPLE = 4096
LEAF = 64
FANOUT = 16
#: A node is split if its children's radii, weighed by their points, come to at most this share of its own.
SHRINK = 0.8
SCALE = 1024


class Node:
    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, rows: np.ndarray, x: np.ndarray):
        points = x[rows]
        self.rows = rows
        mean = points.mean(axis=0)
        self.centre = points[((points - mean) ** 2).sum(axis=1).argmin()]
        distance = np.sqrt(((points - self.centre) ** 2).sum(axis=1))
        self.radius = float(distance.max())
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.children: list[Node] = []
        if len(rows) > LEAF and self.radius > 0:
            owner, nearest = self._net(points, distance)
            parts = [np.flatnonzero(owner == i) for i in range(owner.max() + 1)]
            parts = [part for part in parts if len(part)]
            # children that cover hardly less than their parent prune nothing: then the node is a leaf
            if len(parts) > 1 and sum(len(part) * nearest[part].max() for part in parts) <= SHRINK * len(rows) * self.radius:
                self.children = [Node(rows[part], x) for part in parts]

    def _net(self, points: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest net point of each point and its distance; net points are added farthest first until all lie within half the radius."""
        owner = np.zeros(len(points), np.int64)
        nearest = distance.copy()
        for i in range(1, FANOUT):
            far = int(nearest.argmax())
            if nearest[far] <= self.radius / 2:
                break
            d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
            closer = d < nearest
            owner[closer], nearest[closer] = i, d[closer]
        return owner, nearest


class Search:
    """k best points of each query, kept as two arrays sorted by (score descending, key ascending)."""

    def __init__(self, queries: np.ndarray, query_keys: np.ndarray, points: np.ndarray, keys: np.ndarray, k: int, least: np.ndarray | None = None):
        self.q, self.qk, self.p, self.pk, self.k = queries, query_keys, points, keys, k
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.score = np.full((len(queries), k), -np.inf)
        self.key = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.compared = 0

    def run(self) -> Search:
        if len(self.q) and len(self.p):
            a, b = Node(np.arange(len(self.q)), self.q), Node(np.arange(len(self.p)), self.p)
            heap = [(-self.bound(a, b), 0, a, b)]
            n = 0
            while heap:
                bound, _, a, b = heapq.heappop(heap)
                if self.pruned(-bound, a):
                    continue
                if not a.children and not b.children:
                    self.leaves(a, b)
                    continue
                split_query = a.children and (not b.children or a.radius > b.radius)
                for c in a.children if split_query else b.children:
                    pair = (c, b) if split_query else (a, c)
                    bound = self.bound(*pair)
                    if not self.pruned(bound, pair[0]):
                        n += 1
                        heapq.heappush(heap, (-bound, n, *pair))
        return self

    @staticmethod
    def bound(a: Node, b: Node) -> float:
        value = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return value + 1e-9 * (abs(value) + a.norm * b.norm + 1)

    def pruned(self, bound: float, a: Node) -> bool:
        return bound < np.maximum(self.score[a.rows, -1], self.least[a.rows]).min()

    def leaves(self, a: Node, b: Node) -> None:
        got = self.q[a.rows] @ self.p[b.rows].T
        self.compared += got.size
        keys = np.broadcast_to(self.pk[b.rows], got.shape)
        got = np.where(keys == self.qk[a.rows][:, None], -np.inf, got)
        able = (got >= np.maximum(self.score[a.rows, -1], self.least[a.rows])[:, None]) & (got > -np.inf)
        if got.shape[1] > self.k:
            able &= got >= np.partition(got, -self.k, axis=1)[:, -self.k :][:, :1]
        row, column = np.nonzero(able)
        if not len(row):
            return
        some = np.unique(row)
        old = np.repeat(some, self.k)
        row = np.concatenate((old, row))
        score = np.concatenate((self.score[a.rows[some]].reshape(-1), got[able]))
        key = np.concatenate((self.key[a.rows[some]].reshape(-1), keys[able]))
        order = np.lexsort((key, -score, row))
        head = np.searchsorted(row[order], some)
        best = order[head[:, None] + np.arange(self.k)]
        self.score[a.rows[some]], self.key[a.rows[some]] = score[best], key[best]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer rows of a list column, padded with zeros or cut at ``width``."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), width), dtype=np.int64)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def _wide(vectors: pd.Series) -> pa.Array:
    return pa.array(vectors, pa.list_(pa.int64()))


def net(points: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Net points, farthest first, from the one nearest to the mean."""
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    nearest = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < cells and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _padded(lists: pa.Array, width: int) -> tuple[np.ndarray, int]:
    """Float rows at least ``width`` wide, and how wide."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(n.max(initial=0)))
    return _matrix(lists, width).astype(np.float64), width


def _assign(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Cell of each row and its distance to the cell's centre."""
    for batch in batches:
        if batch.num_rows:
            x, width = _padded(batch.column(1), shared.value.shape[1])
            centres = np.pad(shared.value, ((0, 0), (0, width - shared.value.shape[1])))
            d = _distances(x, centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "distance"])


def _reach(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Cells other than its own in which a query may find a score of its k-th or more."""
    centres, radii = shared.value
    for batch in batches:
        if batch.num_rows:
            x, width = _padded(batch.column(1), centres.shape[1])
            wide = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
            norm = np.sqrt((x**2).sum(axis=1))
            bound = x @ wide.T + np.outer(norm, radii)
            bound += 1e-9 * (np.abs(bound) + np.outer(norm, np.sqrt((wide**2).sum(axis=1)) + radii) + 1)
            least = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            able = ~(bound < np.where(np.isnan(least), -np.inf, least)[:, None]) & (radii >= 0)
            able[np.arange(len(x)), batch.column(3).to_numpy()] = False
            row, cell = np.nonzero(able)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in (0, 1, 2)), pa.array(cell.astype(np.int32)), taken.column(4)], names=["query_id", "v", "query", "cell", "least"])


_FOUND = "query_id long, query long, vec_id long, score long"


def _search(k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({name.split()[0]: np.zeros(0, np.int64) for name in _FOUND.split(", ")})
        lists = _wide(points["v"]), _wide(queries["v"])
        width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in lists)
        p, q = (_matrix(x, width) for x in lists)
        pk, qk, query = points["vec_id"].to_numpy(), queries["query_id"].to_numpy(), queries["query"].to_numpy()
        least = queries["least"].to_numpy(dtype=np.float64, na_value=-np.inf)
        order = np.argsort(pk, kind="stable")
        p, pk = p[order], pk[order]
        largest = max(abs(int(m)) for x in (p, q) for m in (x.min(initial=0), x.max(initial=0)))
        if width * largest * largest >= 1 << 52:
            # beyond what doubles hold: Python's integers, block by block
            score = q.astype(object) @ p.astype(object).T
            score[pk[None, :] == qk[:, None]] = None
            rows = [(i, j) for i in range(len(q)) for j in sorted((j for j in range(len(p)) if score[i, j] is not None), key=lambda j: -score[i, j])[:k]]
            row, column = np.array(rows, dtype=np.int64).reshape(-1, 2).T
            best = np.array([max(-(1 << 63), min((1 << 63) - 1, score[i, j])) for i, j in rows], dtype=np.int64)
            return pd.DataFrame({"query_id": qk[row], "query": query[row], "vec_id": pk[column], "score": best})
        found = Search(q.astype(np.float64), qk, p.astype(np.float64), pk, k, least).run()
        row, column = np.nonzero(np.isfinite(found.score))
        return pd.DataFrame({"query_id": qk[row], "query": query[row], "vec_id": found.key[row, column], "score": found.score[row, column].astype(np.int64)})

    return run


def _searched(placed: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int, block: int, query_block: int) -> DataFrame:
    """Rows of ``_FOUND`` from the cells that ``asked`` (query_id, v, query, cell, least) names."""
    queries = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max([*sizes, 0]) + 1
    number = lambda of, per: F.array(*[F.lit(-(-of.get(c, 0) // per)) for c in range(most)])
    blocks, query_blocks = F.get(number(sizes, block), F.col("cell")), F.get(number(queries, query_block), F.col("cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda n: F.pmod(F.xxhash64("v"), n.cast("long")).cast("int")
    points = placed.where(query_blocks > 0).select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), blocks.cast("long")).cast("int").alias("b"), every(query_blocks).alias("qb"))
    groups = asked.where(blocks > 0).select("query_id", "v", "query", "least", "cell", deal(query_blocks).alias("qb"), every(blocks).alias("b"))
    return points.groupBy("cell", "b", "qb").cogroup(groups.groupBy("cell", "b", "qb")).applyInPandas(_search(k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class TopK:
    """The search of one table; ``result`` has (query_id, rank, vec_id, score), ``reached()`` the share of (query, cell) pairs that were searched."""

    def __init__(self, vectors: DataFrame, is_query: Column, key: str, vector: str, k: int, block: int, query_block: int, cells: int):
        spark = vectors.sparkSession
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
        rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        sample = _wide(rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toPandas()["v"])
        x, _ = _padded(sample, 1) if len(sample) else (np.zeros((1, 1)), 1)
        centres = net(x, cells)
        shared = spark.sparkContext.broadcast(centres)
        placed = checkpointed(rows.mapInArrow(lambda it: _assign(it, shared), "vec_id long, v array<long>, is_query boolean, cell int, distance double"))
        of_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
        sizes = {r["cell"]: r["n"] for r in of_cell}
        radii = np.full(len(centres), -1.0)
        radii[[r["cell"] for r in of_cell]] = [r["radius"] for r in of_cell]
        # equal query rows are one query
        self.queries = placed.where("is_query").select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("vec_id", "v").alias("query"), "cell").distinct()
        near = checkpointed(_ranked(_searched(placed, self.queries.withColumn("least", F.lit(None).cast("double")), sizes, k, block, query_block), k).drop("rank"))
        worst = near.groupBy("query_id", "query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
        both = spark.sparkContext.broadcast((centres, radii))
        asked = self.queries.join(worst, ["query_id", "query"], "left").select("query_id", "v", "query", "cell", "least")
        self.asked = checkpointed(asked.mapInArrow(lambda it: _reach(it, both), "query_id long, v array<long>, query long, cell int, least double"))
        self.cells = len(sizes)
        self.result = _ranked(near.unionByName(_searched(placed, self.asked, sizes, k, block, query_block)), k).select("query_id", "rank", "vec_id", "score")

    def reached(self) -> float:
        n = self.queries.count()
        return (self.asked.count() + n) / max(1, n * self.cells)


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row where ``is_query`` holds."""
    return TopK(vectors, is_query, key, vector, k, block, query_block, cells).result
