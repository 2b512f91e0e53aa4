"""Intervals, annotation, graphs and fragments on hand-worked cases and properties."""

import random

import pytest
from pyspark.sql import functions as F

from posterra.operators import annotation, components, fragments, intervals, scaling, sets

T1, T2, T3 = [(100, 199), (300, 399), (500, 599)], [(100, 199), (500, 599)], [(100, 399), (500, 599)]


@pytest.fixture(scope="module")
def exons(spark):
    rows = [(t, "G1", "g", "chr1", "+", s, e) for t, list_ in (("T1", T1), ("T2", T2), ("T3", T3)) for s, e in list_]
    return spark.createDataFrame(rows, "transcript_id string, gene_id string, gene_name string, seqname string, strand string, start long, end long")


@pytest.fixture(scope="module")
def numbered(exons):
    t = annotation.with_gene_tgroup(annotation.with_tid(annotation.transcript_table(exons)))
    return t, exons.join(t.select("transcript_id", "tid"), "transcript_id")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_transcripts(numbered):
    t, _ = numbered
    assert rows(t, "tid", "transcript_id", "exonic_length", "tgroup") == [(0, "T1", 300, 0), (1, "T2", 200, 0), (2, "T3", 400, 0)]


def test_features(numbered):
    _, e = numbered
    got = rows(annotation.features(e), "type", "start", "end", "including", "excluding")
    assert got == [("cassette_exon", 300, 399, [0], [1]), ("retained_intron", 200, 299, [2], [0])]


def test_introns_and_segments(numbered):
    _, e = numbered
    assert rows(intervals.introns(e.where("tid = 0")), "start", "end") == [(200, 299), (400, 499)]
    assert rows(intervals.segments(e, ["seqname", "strand"]), "start", "end") == [(100, 199), (200, 299), (300, 399), (500, 599)]
    assert rows(intervals.union(e, ["seqname"]), "start", "end") == [(100, 399), (500, 599)]


def test_one_base_exon(spark):
    df = spark.createDataFrame([("c", 5, 5), ("c", 3, 8)], "seqname string, start long, end long")
    assert rows(intervals.segments(df, ["seqname"]), "start", "end") == [(3, 4), (5, 5), (6, 8)]


def test_loci_and_gaps(spark):
    df = spark.createDataFrame([("chr1", 100, 599, 1), ("chr1", 550, 800, 2), ("chr1", 900, 950, 3)], "seqname string, min_start long, max_end long, tid int")
    assert rows(intervals.loci(df), "tid", "locus") == [(1, 0), (2, 0), (3, 1)]
    assert rows(intervals.gaps(df, ["seqname"], "min_start", "max_end"), "start", "end") == [(801, 899)]


def test_offsets_and_overhang(numbered, spark):
    _, e = numbered
    at = spark.createDataFrame([(0, 100), (0, 310), (0, 201), (0, 599), (0, 250)], "tid int, pos long")
    assert rows(intervals.to_transcript(at, e), "pos", "offset") == [(100, 0), (201, 99), (310, 110), (599, 299)]


def test_segments_partition_the_union(spark):
    rng = random.Random(3)
    data = [("c", s, s + rng.randrange(30)) for s in (rng.randrange(200) for _ in range(60))]
    df = spark.createDataFrame(data, "seqname string, start long, end long")
    cover = {x for _, s, e in data for x in range(s, e + 1)}
    for pieces in (rows(intervals.segments(df, ["seqname"]), "start", "end"), rows(intervals.union(df, ["seqname"]), "start", "end")):
        seen = [x for s, e in pieces for x in range(s, e + 1)]
        assert len(seen) == len(set(seen)) and set(seen) == cover


@pytest.mark.parametrize("contained", [False, True])
def test_overlap_join(spark, contained):
    rng = random.Random(5)
    make = lambda n: [(i, s, s + rng.randrange(40)) for i, s in enumerate(rng.randrange(500) for _ in range(n))]
    a, b = make(80), make(60)
    left = spark.createDataFrame([("c", *r) for r in a], "k string, i int, s1 long, e1 long")
    right = spark.createDataFrame([("c", *r) for r in b], "k string, j int, s2 long, e2 long")
    want = sorted((i, j) for i, s, e in a for j, x, y in b if ((x <= s and e <= y) if contained else (s <= y and e >= x)))
    assert rows(intervals.overlap_join(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), 16, contained), "i", "j") == want


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 4)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20), ("b", 6, 60)], "k string, t long, v int")
    assert rows(intervals.bounded_asof(left, right, ["k"], "t", "v", "got").where("got is not null"), "k", "t", "got") == [("a", 5, 50), ("a", 9, 50)]
    assert rows(intervals.bounded_asof(left, right, ["k"], "t", "v", "got", strict=True).where("got is not null"), "k", "t", "got") == [("a", 5, 20), ("a", 9, 50)]


def test_tss_groups(spark):
    t = spark.createDataFrame([(0, "c", "+", 100, 900, 500), (1, "c", "+", 200, 900, 500), (2, "c", "+", 340, 900, 500), (3, "c", "+", 900, 990, 90), (4, "c", "-", 100, 900, 500)], "tid int, seqname string, strand string, min_start long, max_end long, exonic_length long")
    assert rows(annotation.with_tss_tgroup(t), "tid", "tgroup") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = rows(components.connected_components(spark.createDataFrame(edges, "a long, b long"), few=few), "node", "component")
    assert got == sorted((x, find(x)) for x in parent)


def test_fragment_components(spark):
    w = spark.createDataFrame([(0, 0, "f0"), (0, 1, "f0"), (0, 1, "f1"), (0, 2, "f2")], "sample int, tid int, frag string")
    apart = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "tid int, tgroup int")
    joined = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "tid int, tgroup int")
    assert rows(components.fragment_components(w, apart), "tid", "component") == [(0, 0), (1, 0), (2, 1)]
    assert rows(components.fragment_components(w, joined), "tid", "component") == [(0, 0), (1, 0), (2, 0)]


def test_quantile_scale(spark):
    v = spark.createDataFrame([(0, 0, float(i)) for i in range(1, 11)] + [(0, 1, 2.0 * i) for i in range(1, 11)], "draw int, sample int, value double")
    assert rows(scaling.quantile_scale(v), "sample", "scale") == [(0, 1.0), (1, 0.5)]
    three = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 3.0), (1, 6.0), (1, 6.0)], "sample int, value double")
    assert rows(scaling.quantile_scale(three, by=()), "sample", "scale") == [(0, 1.0), (1, 0.5)]


def test_prune(spark):
    a = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.05), (1, "z", 0.05)], "read int, locus string, align_pr double")
    assert rows(fragments.prune(a), "locus") == [("x",)]


def test_best_alignment_first_of_equals(spark):
    a = spark.createDataFrame([(1, 1, 0, 0.5, 2.0), (1, 1, 1, 1.0, 1.0), (1, 2, 0, 0.1, 1.0), (1, 2, 1, 0.4, 1.0)], "tid int, read int, seq int, align_pr double, w double")
    assert rows(fragments.best_alignment(a), "read", "seq") == [(1, 0), (2, 1)]


def test_gene_counts_keep_zeros(spark):
    pairs = spark.createDataFrame([("f1", "G1"), ("f1", "G1"), ("f2", "G1"), ("f2", "G2")], "frag string, gene_id string")
    genes = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "gene_id string")
    assert rows(fragments.gene_counts(pairs, genes), "gene_id", "count") == [("G1", 1), ("G2", 0), ("G3", 0)]


def test_gc_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.64,), (0.99,), (1.0,)], "gc double").select(fragments.gc_bin(F.col("gc")).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 1, 13, 14, 14]


def test_valid_fragment(spark):
    ok = lambda kind, n, r1, r2, left: spark.range(1).select(fragments.valid_fragment(kind, *map(F.lit, (n, r1, r2, left)))).first()[0]
    assert ok("FR", True, False, True, True) and not ok("FR", True, True, False, True) and ok("RF", True, True, False, True)
    assert ok("FF", True, False, False, True) and not ok("FF", True, False, True, True) and not ok("FR", False, False, True, True)
    with pytest.raises(ValueError):
        fragments.valid_fragment("XX", F.lit(True), F.lit(True), F.lit(True), F.lit(True))


def test_classes_by_set_count_pairs(spark):
    """As many as join_by_set makes, with nulls, and the pairs of a million owners with a million."""
    rng = random.Random(9)
    data = [(rng.random() < 0.5, rng.randrange(40), rng.choice([None, 0, 1, 2])) for _ in range(200)]
    df = spark.createDataFrame(data, "early boolean, owner long, m long")
    met = sets.join_by_set(df.where("early"), df.where("not early"), "owner", "m").groupBy("relation", "size")
    want = rows(met.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("left_owner"), F.lit(0)).alias("l"), F.coalesce(F.sum("right_owner"), F.lit(0)).alias("r")), "relation", "size", "n", "l", "r")
    total = [F.sum(c).cast("long").alias(c) for c in ("n", "of_left", "of_right")]
    assert rows(sets.classes_by_set(df, "early", "owner", "m", "owner").groupBy("relation", "size").agg(*total), "relation", "size", "n", "of_left", "of_right") == want
    many = spark.range(2_000_000).select((F.col("id") % 2 == 0).alias("early"), F.col("id").alias("owner"), F.lit(1).alias("m"))
    (one,) = sets.classes_by_set(many, "early", "owner", "m", "owner").collect()
    assert (one.relation, one.n, one.of_left, one.of_right) == ("same", 10**12, 999_999 * 10**12, 10**18)


def test_labelled_segments(spark):
    """Against brute force, with gaps over many bins, reversed and one-base intervals, null and repeated members; no pair of a piece and an interval is shuffled."""
    rng = random.Random(6)
    data = [(rng.choice("ab"), s, s + rng.choice([0, 3, 25, 70, 200, -1, -5]), rng.choice([None, "x", "y", "z", str(s)])) for s in (rng.randrange(-40, 900) for _ in range(90))] + [("a", 5000, 5300, "far")]
    df = spark.createDataFrame(data, "k string, start int, end int, m string")
    want = []
    for k in "ab":
        own = [r for r in data if r[0] == k]
        cuts = sorted({x for _, s, e, _ in own for x in (s, e + 1)})
        for a, b in zip(cuts, cuts[1:]):
            if any(s <= a and a <= e for _, s, e, _ in own):
                want.append((k, a, b - 1, sorted({m for _, s, e, m in own if s <= a <= e and m is not None})))
    got = intervals.labelled_segments(df, ["k"], "m", bin_width=32)
    assert rows(got, "k", "start", "end", "members") == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")


def test_fragments_of_one_group_are_no_edges(spark, monkeypatch):
    """Only fragments of several tgroups tie anything; transcripts in two tgroups or none, null fragments."""
    calls = []
    monkeypatch.setattr(components, "connected_components", lambda e, f=components.connected_components: calls.append(e.count()) or f(e))
    w = spark.createDataFrame([(0, t, f) for t in range(6) for f in (f"f{t // 2}", f"g{t}", None)] + [(1, 3, "f1")], "sample int, tid int, frag string")
    pairs = spark.createDataFrame([(t, t // 2) for t in range(4)], "tid int, tgroup int")
    loose = spark.createDataFrame([(t, t // 2) for t in range(6)] + [(3, 7), (5, 7)], "tid int, tgroup int")
    assert rows(components.fragment_components(w.where("frag is null or tid < 4"), pairs), "sample", "tid", "component") == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1), (0, 4, 2), (0, 5, 3), (1, 3, 0)]
    assert not calls
    assert rows(components.fragment_components(w, pairs), "tid", "component") == [(0, 0), (1, 0), (2, 1), (3, 0), (3, 1), (4, 2), (5, 2)]
    assert rows(components.fragment_components(w, loose), "tid", "component") == [(0, 0), (1, 0), (2, 1), (3, 0), (3, 1), (4, 1), (5, 1)]
