"""Packing, search and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posterra.llm import oracles, packing, queries, topk

SF = "/root/testdata/sf0.001"


def test_pack_exactly_once_and_within_capacity():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 4097, 3000))[::-1]
    bins, offsets, final, opened = packing.pack(sizes)
    used = np.bincount(bins, weights=sizes)
    assert (used <= final).all() and (final <= opened).all() and set(final.tolist()) <= set(packing.CAPACITIES)
    smaller = {512: 0, 1024: 512, 2048: 1024, 4096: 2048}
    assert all(u > smaller[int(c)] for u, c in zip(used, final, strict=True))
    for b in range(len(final)):
        rows = np.flatnonzero(bins == b)
        order = rows[np.argsort(offsets[rows])]
        assert offsets[order].tolist() == np.concatenate(([0], np.cumsum(sizes[order])[:-1])).tolist()
    assert used.sum() / final.sum() > 0.98


def brute_pack(sizes, capacities):
    """Best fit by its definition: every open bin and every capacity is looked at for every item."""
    bins, opened, where = [], [], []
    for i, size in enumerate(sizes):
        fits = [(c - sum(b) - size, j) for j, (b, c) in enumerate(zip(bins, opened, strict=True)) if sum(b) + size <= c]
        if fits:
            j = min(fits)[1]
        else:
            best = None
            for c in capacities:
                if c >= size:
                    left = c - size
                    for x in sizes[i + 1 :]:
                        left -= x if x <= left else 0
                    price = (c * (1 + c / packing.ATTENTION) + packing.BIN_COST) / (c - left)
                    best = min(best or (price, c), (price, c))
            j = len(bins)
            bins.append([])
            opened.append(best[1])
        bins[j].append(size)
        where.append(j)
    return where, [min(c for c in capacities if c >= sum(b)) for b in bins], opened


def test_pack_against_brute_force():
    rng = np.random.default_rng(7)
    for case in range(40):
        capacities = [(512, 1024, 2048, 4096), (10, 16, 25), (100,)][case % 3]
        sizes = sorted(rng.integers(1, capacities[-1] + 1, int(rng.integers(1, 60))).tolist() + [capacities[0] // 2] * (case % 4), reverse=True)
        bins, _, final, opened = packing.pack(np.array(sizes), capacities)
        assert (bins.tolist(), final.tolist(), opened.tolist()) == brute_pack(sizes, capacities)


def test_sizes_compete_on_documents(spark):
    """Several sizes are opened, and together they cost less than any one of them alone could."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = packing.best_fit(docs).toPandas()
    bins = items.groupby("bin_id").agg(capacity=("capacity", "first"), opened=("opened", "first"))
    assert len(set(bins["opened"])) >= 3
    joint = sum(packing.cost(int(c)) for c in bins["capacity"])
    alone = packing.best_fit(docs, capacities=(4096,)).select("bin_id").distinct().count() * packing.cost(4096)
    assert joint < alone


def test_opening_takes_the_cheapest():
    assert packing.opening(100, [], 0, (512, 1024)) == 512
    assert packing.opening(600, [400] * 5, 5, (512, 1024, 2048)) == 1024
    assert packing.opening(600, [700] * 5, 5, (1024, 2048)) == 2048
    assert packing.opening(512, [], 0, (512, 1024)) == 512
    assert packing.fill(10, [1, 2, 4, 4, 7], 5) == 10 and packing.fill(3, [], 0) == 0


def test_best_fit_cases(spark):
    rows = [(1, "w " * 5000), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "x y z"), (5, " \n ")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, size int")
    got = packing.best_fit(docs).collect()
    assert sorted(((r.doc_id or -1), r.piece, r.n_words) for r in got) == [(-1, 0, 3), (1, 0, 4096), (1, 1, 904), (4, 0, 2), (4, 0, 2)]
    assert packing.best_fit(docs.limit(0)).count() == 0


def test_shards_hold_items_not_documents(spark):
    """Two long documents make as many shards as their items need."""
    docs = spark.createDataFrame([(i, "w " * 2_000_000) for i in range(2)] + [(9, "a b")], "doc_id long, text string")
    got = packing.best_fit(docs, shard_items=64).withColumn("shard", F.shiftright("bin_id", 32))
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == 2 * 489 + 1 and max(sizes) < 128 and len(sizes) > 8


def brute(vectors, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "cells"), [(7, 5), (5000, 64)])
def test_top_k(spark, block, cells):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    vectors = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(420)]
    vectors += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (600, vectors[3][1]), (601, vectors[3][1]), (700, [0.5]), (None, vectors[0][1]), (800, []), (900, [1.0, 0.0]), (900, [0.0, 1.0]), (900, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank int, score string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block=block, query_block=3, cells=cells).collect()
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert sorted(tuple(r) for r in got) == brute(exact, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_cells_are_skipped(spark):
    """Queries of clustered vectors go to few cells besides their own."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 5
    df = spark.createDataFrame([(i, (centres[i % 12] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2400)], "vec_id long, embedding array<double>")
    search = topk.TopK(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding", 10, 64, 64, 24)
    assert search.reached() < 0.5
    assert sorted(tuple(r) for r in search.result.collect()) == brute([(r.vec_id, r.embedding) for r in df.collect()], 10)


def test_dual_tree_prunes_and_large_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 2000
    x = np.floor(centres[np.arange(8000) % 40] + rng.normal(size=(8000, 16)))
    found = topk.Search(x[:400], np.arange(400), x, np.arange(8000), 10).run()
    assert found.compared < 0.6 * 400 * 8000
    full = x[:400] @ x.T
    full[np.arange(400), np.arange(400)] = -np.inf
    assert (found.score == -np.sort(-full, axis=1)[:, :10]).all()
    big = spark.createDataFrame([(i, [1e6 * (i + 1), 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = topk.top_k(big, F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(4, 1024_000_000 * 5120_000_000 + 3072 * 3072), (3, 1024_000_000 * 4096_000_000 + 3072 * 3072)]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tests.llm.test_text import brute_components, brute_pii, brute_repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:-1]]
    clean, one, cut, red = rows[1:]
    groups = brute_components([(i, r.text) for i, r in clean.items()])
    assert set(one) == {i for i, _, c in groups if i == c}
    want = brute_repeats([(i, r.text) for i, r in one.items()], 50)
    for i, r in one.items():
        n, _, n_cut, left = want[i, r.text]
        assert (i in cut) == (n_cut < n or n_cut == 0)
        if i in cut:
            assert cut[i].text.split() == left.split() and cut[i].n_chars == len(cut[i].text)
    assert set(red) == set(cut) and not any(brute_pii(r.text) for r in red.values())
    packed = {}
    for r in frames[-1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_words
    assert packed == {i: len(r.text.split()) for i, r in red.items() if r.text.split()}


def test_stages_of_odd_tables(spark):
    """Empty tables, nulls in any column, repeated rows, and more columns with names that operators use."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(120))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_text int, id string, __doc string"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, "mail a@b.cd now"), (None, text.upper()), (5, text.replace("word60", "other"))]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, "a", None, "b", "c") for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            n = out.count()
            assert n > 0 or table is not docs
            if table is not docs:
                assert n == 0
    one = corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()
    assert [r.doc_id for r in one if r.text and r.text.startswith("word")] == [1] and len(one) == 5


def test_run_and_oracles(spark):
    import duckdb

    assert set(oracles.oracle_sql()) <= set(queries.queries())
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
    assert queries.pipeline(spark, SF).count() > 100
