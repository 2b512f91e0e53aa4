"""Posterior summaries on hand-worked draws."""

import math

import pytest
from pyspark.sql import functions as F

from posterra.plans import summaries


@pytest.fixture(scope="module")
def transcripts(spark):
    return spark.createDataFrame([(0, "T0", "G", "g", 0), (1, "T1", "G", "g", 0), (2, "T2", "H", "h", 1)], "tid int, transcript_id string, gene_id string, gene_name string, tgroup int")


def by_condition(spark, values):
    return spark.createDataFrame([(d, c, t, float(v)) for (c, t), vs in values.items() for d, v in enumerate(vs)], "draw int, condition int, tid int, value float")


def test_fold_change(spark, transcripts):
    mean = by_condition(spark, {(0, 0): [4, 1, 8, 2], (1, 0): [1, 4, 2, 2]})
    r = summaries.differential_transcript_expression(mean, transcripts, 1.0, 0.5).first()
    assert (r.up_pr, r.down_pr, r.median_change) == (0.5, 0.25, 2.0)


def test_splice_change(spark, transcripts):
    mu = by_condition(spark, {(0, 0): [0.9, 0.1, 0.5, 1.2], (1, 0): [0.5, 0.5, 0.5, 0.7]})
    r = summaries.differential_splicing(mu, transcripts, 0.2).first()
    assert (r.up_pr, r.down_pr) == (0.5, 0.25) and r.median_change == pytest.approx(0.3, abs=1e-6)
    assert summaries.differential_splicing(mu, transcripts, 0.0).first().down_pr == 0.5


def test_expression_and_scale(spark, transcripts):
    quant = spark.createDataFrame([(d, 0, 0, float(v)) for d, v in enumerate([10, 20, 30, 40])], "draw int, sample int, tid int, value float")
    scale = spark.createDataFrame([(d, 0, 2.0) for d in range(4)], "draw int, sample int, scale float")
    r = summaries.transcript_expression(quant, scale, transcripts, 0.95).first()
    assert (r.estimate, r.lower, r.upper) == (12.5e6, 5e6, 20e6)
    assert summaries.transcript_expression(quant, scale, transcripts, None, normalize=True).first().estimate == 25e6


def test_shares_sum_to_one(spark, transcripts):
    quant = spark.createDataFrame([(0, 0, t, float(v)) for t, v in enumerate([1, 3, 5])], "draw int, sample int, tid int, value float")
    got = {r.tid: r.value for r in summaries.shares(quant, transcripts).collect()}
    assert got == {0: 0.25, 1: 0.75}


def test_zero_folds(spark, transcripts):
    mean = by_condition(spark, {(0, 0): [0, 1, 0], (1, 0): [1, 0, 0]})
    r = summaries.differential_transcript_expression(mean, transcripts, 1.0).first()
    assert (r.up_pr, r.down_pr) == (pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_feature_splicing_modes(spark, transcripts):
    mean = by_condition(spark, {(0, 0): [0.2], (0, 1): [0.3], (0, 2): [0.5]})
    mu = by_condition(spark, {(0, 0): [0.4], (0, 1): [0.6]})
    features = spark.createDataFrame([(0, [0], [1]), (1, [0], [2])], "feature_id int, including array<int>, excluding array<int>")
    for compat in (False, True):
        rows = summaries.feature_splicing_rate(mean, mu, features, transcripts, compat).collect()
        assert [r.feature_id for r in rows] == [0] and rows[0].value == pytest.approx(0.4, abs=1e-6)


def test_unknown_group_member_is_an_error(spark, transcripts):
    groups = spark.createDataFrame([(0, 0, "T0"), (0, 1, "nope")], "group int, position int, transcript_id string")
    with pytest.raises(Exception, match="no such transcript"):
        summaries.group_members(groups, transcripts).collect()


def test_swapping_conditions_swaps_tails(spark, transcripts):
    a, b = [4, 1, 8, 2, 3], [1, 4, 2, 2, 9]
    one = summaries.differential_transcript_expression(by_condition(spark, {(0, 0): a, (1, 0): b}), transcripts).first()
    two = summaries.differential_transcript_expression(by_condition(spark, {(0, 0): b, (1, 0): a}), transcripts).first()
    assert (one.up_pr, one.down_pr) == (two.down_pr, two.up_pr) and one.median_change == -two.median_change and one.up_pr + one.down_pr <= 1


def test_order_frequency(spark):
    rates = by_condition(spark, {(0, 0): [1, 1, 3], (1, 0): [2, 2, 1]})
    r = summaries.ordering_frequency(rates, ["tid"]).collect()
    assert [(x.ordering, x.frequency) for x in r] == [("0<1", pytest.approx(2 / 3))]


def test_pairwise_splicing_both_ways(spark):
    mu = by_condition(spark, {(0, 0): [0.5] * 4, (1, 0): [0.25] * 4})
    got = {(r.condition_a, r.condition_b): (r.lower, r.upper) for r in summaries.pairwise_splicing(mu).collect()}
    assert got == {(0, 1): (1.0, 1.0), (1, 0): (-1.0, -1.0)} and not math.isnan(got[0, 1][0])


def test_empty_input(spark, transcripts):
    mu = by_condition(spark, {(0, 0): [0.5]}).where(F.lit(False))
    assert summaries.differential_splicing(mu, transcripts).count() == 0
