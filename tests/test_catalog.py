"""Every query with SQL against DuckDB on the smallest tables, and the contract's functions."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from posterra.plans import places, reads

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
QUICK = (
    "transcript_expression", "gene_expression", "diff_group", "diff_splicing", "feature_splicing", "pairwise_splicing", "quantile_normalization", "tss_cluster", "consensus_segments", "interval_union",
    "retained_features", "interval_containment", "bounded_asof", "emp_dist", "gene_counts", "best_alignment", "connected_components", "js_divergence", "attribute_map", "cigar_ops",
)


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("entry_under_test", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_names(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [*QUICK, *reads.QUERIES, *places.QUERIES])
def test_against_sql(spark, entry, con, name):
    df = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["geometric_mle", "slice_sampler", "gibbs_round"])
def test_models_run_and_repeat(spark, entry, name):
    one, two = (sorted(map(tuple, entry.queries()[name](spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_components_of_all_lines(spark, entry, con):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in con.execute("SELECT DISTINCT l_orderkey * 2, l_partkey * 2 + 1 FROM lineitem").fetchall():
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    got = entry.queries()["connected_components_of_all_lines"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in list(above))


def test_entry(spark, entry):
    assert entry.entry(spark).count() > 0
