"""Column functions on hand-worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from posterra.functions import cigar as C
from posterra.functions import seq as S
from posterra.functions import stats as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("values", "level", "low", "high", "median"),
    [([10, 20, 30, 40], 0.95, 10, 40, 30), ([40, 10, 30, 20], 0.5, 20, 30, 30), ([1, 2, 3], 0.5, 2, 3, 2), ([7], 0.95, 7, 7, 7), ([1, 2, 3, 4, 5], 0.5, 2, 4, 3)],
)
def test_rank_picks(spark, values, level, low, high, median):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy().agg(T.draws("v").alias("d"))
    lo, hi = T.bounds(level)
    assert tuple(rows.select(T.nearest_rank(F.col("d"), lo), T.nearest_rank(F.col("d"), hi), T.upper_median(F.col("d"))).first()) == (low, high, median)


def test_truncated_rank(spark):
    rows = spark.range(40).groupBy().agg(T.draws(F.col("id")).alias("d"))
    assert tuple(rows.select(T.truncated_rank(F.col("d"), 0.05), T.truncated_rank(F.col("d"), 0.95)).first()) == (2, 38)


def test_division_and_logs_keep_infinities(spark):
    d = lambda x: F.lit(float(x))
    got = one(spark, T.safe_div(d(1), d(0)), T.safe_div(d(-1), d(0)), T.safe_div(d(0), d(0)), T.safe_log2(d(0)), T.safe_log2(d(-1)), T.safe_log2(d(8)), T.log2_fold_change(d(0), d(4)))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and math.isnan(got[4]) and got[5] == 3 and got[6] == -math.inf


def test_logaddexp(spark):
    d = lambda x: F.lit(float(x))
    got = one(spark, T.logaddexp(d(0), d(0)), T.logaddexp(d("-inf"), d("-inf")), T.logaddexp(d(-1000), d(0)))
    assert got[0] == pytest.approx(math.log(2)) and got[1] == -math.inf and got[2] == 0


def test_log_sum_exp(spark):
    rows = spark.createDataFrame([(1, -1000.0), (1, -1001.0), (2, float("-inf")), (2, float("-inf")), (3, 0.0)], "k int, x double")
    got = {r.k: r.v for r in rows.groupBy("k").agg(T.log_sum_exp(F.col("x")).alias("v")).collect()}
    assert got[1] == pytest.approx(-1000 + math.log1p(math.exp(-1))) and got[2] == -math.inf and got[3] == 0


def test_tails_do_not_count_nan(spark):
    x = F.lit(float("nan"))
    assert one(spark, *T.fold_tails(x, 1.0), *T.change_tails(x, 0.0)) == (0, 0, 0, 0)
    assert one(spark, *T.fold_tails(F.lit(1.0), 1.0), *T.change_tails(F.lit(0.0), 0.0)) == (1, 0, 0, 1)


def test_sequences(spark):
    s = F.lit("AACG")
    assert one(spark, S.reverse_complement(F.lit("ACGT")), S.reverse_complement(s), S.gc_count(s), S.gc_count_range(s, F.lit(1), F.lit(2)), S.kmer_number(F.lit("CG")), S.kmer_number(F.lit("CN")), S.kmer_string(F.lit(6), 2)) == ("ACGT", "CGTT", 2, 1, 6, None, "cg")
    assert one(spark, S.padded_substring(s, F.lit(-2), F.lit(4)), S.padded_substring(s, F.lit(2), F.lit(4)), S.padded_substring(s, F.lit(1), F.lit(2))) == ("NNAA", "CGNN", "AC")
    mask = F.array(F.lit(True), F.lit(False), F.lit(False), F.lit(True))
    assert one(spark, S.masked_kmer_number(s, mask)) == (2,)


def test_spliced_sequence(spark):
    exons = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end")))
    assert one(spark, S.spliced(F.lit("ACGTACGT"), exons), S.spliced(F.lit("ACGTACGT"), exons, 2, 1)) == ("CGAC", "NACGACG")


def test_natural_order(spark):
    names = ["chr10", "chr2", "chrX", "chr10_alt"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_number(F.col("n")), "n")
    assert [r.n for r in rows.collect()] == ["chrX", "chr2", "chr10", "chr10_alt"]


def test_attributes_last_key_wins(spark):
    m = one(spark, S.attribute_map(F.lit("gene_id \"G1\"; transcript_id 'T 1'; level 2; gene_id \"G2\";")))[0]
    assert m == {"gene_id": "G2", "transcript_id": "T 1", "level": "2"}


def test_cigar(spark):
    ops, pos = C.operations(F.lit("5S10M100N10M")), F.lit(100)
    assert one(spark, C.true_position(pos, ops), C.true_end(pos, ops), C.reference_end(pos, ops)) == (95, 220, 220)
    blocks = one(spark, C.aligned_blocks(pos, ops))[0]
    assert [(b.start, b.end) for b in blocks] == [(100, 109), (210, 219)]
    deleted = one(spark, C.aligned_blocks(pos, C.operations(F.lit("5M2D5M3I4M"))))[0]
    assert [(b.start, b.end) for b in deleted] == [(100, 115)]
    placed = one(spark, C.placed(pos, ops))[0]
    assert [(p.op, p.start, p.end) for p in placed] == [("S", 95, 99), ("M", 100, 109), ("N", 110, 209), ("M", 210, 219)]
    assert one(spark, *C.soft_clips(ops)) == (5, 0)
    assert one(spark, F.size(C.operations(F.lit("*")))) == (0,)


def test_mismatches_prefer_md(spark):
    tags = F.create_map(F.lit("NM"), F.lit("7"))
    none = F.lit(None).cast("string")
    assert one(spark, C.mismatches(tags, F.lit("10A5^AC6T1")), C.mismatches(tags, none)) == (2, 7)


def test_attribute_in_is_attribute_map(spark):
    """On odd texts: repeated and missing keys, either quote, marks within quotes, line ends, no blanks."""
    rng = random.Random(8)
    parts = ["a", "b", "gene", " ", "  ", ";", "; ", '"', "'", '"x y"', "'p;q'", '"r;s"', "\t", "\n", "\r", " ", "-", '"" ', "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + ['a "1"; b "2"; a \'3\';', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys, values = S.attribute_lists(F.col("t"))
    pairs = [(F.try_element_at(S.attribute_map(F.col("t")), F.lit(k)), S.attribute_in(keys, values, k)) for k in ("a", "b", "gene", "none")]
    found = df.select("t", *[x.alias(f"x{i}_{j}") for i, p in enumerate(pairs) for j, x in enumerate(p)]).collect()
    for r in found:
        for i in range(4):
            assert r[f"x{i}_0"] == r[f"x{i}_1"], (r, i)
    assert sum(r.x0_1 is not None for r in found) > 30
