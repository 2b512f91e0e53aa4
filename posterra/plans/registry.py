"""Summaries by name over a posterior store, and the small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import summaries


class Store:
    """Tables of one posterior store, read when asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, table: str) -> DataFrame:
        return store.read(self.spark, self.path, table)


STRATEGIES = {
    "transcript-expression": lambda s, o: summaries.transcript_expression(s.quant, s.scaling, s.transcripts, o.credible, o.normalize),
    "transcript-splicing": lambda s, o: summaries.transcript_splicing(s.quant, s.transcripts, o.credible),
    "gene-expression": lambda s, o: summaries.gene_expression(s.quant, s.scaling, s.transcripts, o.credible, o.normalize),
    "feature-expression": lambda s, o: summaries.feature_expression(s.quant, s.scaling, s.features, o.credible, o.normalize),
    "condition-transcript-expression": lambda s, o: summaries.condition_transcript_expression(s.condition_mean, s.transcripts, o.credible),
    "condition-gene-expression": lambda s, o: summaries.condition_gene_expression(s.condition_mean, s.transcripts, o.credible),
    "condition-feature-expression": lambda s, o: summaries.condition_feature_expression(s.condition_mean, s.features, o.credible),
    "differential-transcript-expression": lambda s, o: summaries.differential_transcript_expression(s.condition_mean, s.transcripts, o.effect_or(1.0), o.credible),
    "differential-gene-expression": lambda s, o: summaries.differential_gene_expression(s.condition_mean, s.transcripts, o.effect_or(1.0), o.credible),
    "differential-group-expression": lambda s, o: summaries.differential_group_expression(s.condition_mean, o.groups_of(s.spark), s.transcripts, o.effect_or(1.0), o.credible),
    "differential-splicing": lambda s, o: summaries.differential_splicing(s.condition_splice_mu.drop("tgroup"), s.transcripts, o.effect_or(0.2), o.credible),
    "differential-feature-splicing": lambda s, o: summaries.differential_feature_splicing(s.condition_mean, s.condition_splice_mu.drop("tgroup"), s.features, s.transcripts, o.effect_or(0.2), o.credible),
    "condition-feature-splicing-samples": lambda s, o: summaries.condition_feature_splicing_samples(s.condition_mean, s.condition_splice_mu.drop("tgroup"), s.features, s.transcripts),
    "condition-splicing": lambda s, o: summaries.condition_splicing(s.condition_splice_mu.drop("tgroup"), s.transcripts, o.credible),
    "experiment-splicing": lambda s, o: summaries.experiment_splicing(s.experiment_splice_mu.drop("tgroup"), s.transcripts, o.credible),
    "experiment-splicing-sigma": lambda s, o: summaries.experiment_splicing_sigma(s.experiment_splice_sigma.drop("tgroup"), s.transcripts, o.credible),
}


class Choices:
    """What a summary is asked for."""

    def __init__(self, credible: float | None = None, effect: float | None = None, normalize: bool = False, groups: str | None = None):
        self.credible, self.effect, self.normalize, self.groups = credible, effect, normalize, groups

    def effect_or(self, default: float) -> float:
        return default if self.effect is None else self.effect

    def groups_of(self, spark: SparkSession) -> DataFrame:
        from ..sources.annotation import read_groups

        if not self.groups:
            raise ValueError("this summary needs a groups file")
        return read_groups(spark, self.groups)


def summarize(spark: SparkSession, path: str, strategy: str, choices: Choices | None = None) -> DataFrame:
    """Upper case and underscores in the name are accepted."""
    name = strategy.lower().replace("_", "-")
    if name not in STRATEGIES:
        raise ValueError(f"No such summarization strategy: {strategy}")
    return STRATEGIES[name](Store(spark, path), choices or Choices())


def report(spark: SparkSession, path: str) -> str:
    """Sizes, files by condition, and the run's metadata, as text."""
    s = Store(spark, path)
    sizes = summaries.describe(s.samples, s.transcripts).first().asDict()
    lines = [f"{v} {k.removeprefix('n_')}" for k, v in sizes.items()]
    for row in summaries.files_by_condition(s.samples).orderBy("condition_name").collect():
        lines += [f"{row.condition_name}:", *(f"  {f}" for f in row.files)]
    for row in s.run_metadata.limit(1).collect():
        lines += [f"{k}: {v}" for k, v in row.asDict().items() if v not in (None, "")]
    return "\n".join(lines)


def trace(spark: SparkSession, path: str, transcript_id: str) -> DataFrame:
    """One row a round: experiment rate, then each condition's; an unknown or unspliced transcript is an error."""
    s = Store(spark, path)
    found = s.transcripts.where(F.col("transcript_id") == transcript_id)
    if found.isEmpty():
        raise ValueError(f"no such transcript: {transcript_id}")
    rows = summaries.trace(s.experiment_splice_mu, s.condition_splice_mu, s.transcripts, transcript_id)
    if rows.isEmpty():
        raise ValueError(f"not alternatively spliced: {transcript_id}")
    n = s.samples.agg(F.max("condition")).first()[0] + 1
    return store.wide(rows, ["round"], "condition", {-1: "ex_mu", **{i: f"mu{i}" for i in range(n)}}, {"value": ""})


def quality_report(pairs: DataFrame, models) -> dict:
    """What the QC file holds of one sample: its compatible ``pairs`` counted, and its ``Library``'s models; each part is bounded."""
    upto = models.lengths.cdf.searchsorted(1 - 1e-5)
    counts = pairs.agg(F.count_distinct("frag").alias("f"), F.count(F.lit(1)).alias("p")).first()
    return {
        "fragments": counts.f, "compatible_pairs": counts.p, "strand_specificity": float(models.specificity), "three_prime": float(models.three_prime), "fragmentation": models.fragmentation,
        "fragment_length_pmf": [[i, float(p)] for i, p in enumerate(models.lengths.pdf[: upto + 1]) if p > 0],
        "gc_bins": None if models.gc is None else [[i, float(b)] for i, b in enumerate(models.gc)],
        "motif_places": None if models.motifs is None else [sorted(m.parents) for m in models.motifs],
    }


def motif_difference(scores: DataFrame) -> DataFrame:
    """(sample_a, sample_b, difference): mean absolute log2 ratio of two samples' sequence bias over positions."""
    a = scores.select("position", F.col("sample").alias("sample_a"), F.col("bias").alias("x"))
    b = scores.select("position", F.col("sample").alias("sample_b"), F.col("bias").alias("y"))
    both = a.join(b, "position").where("sample_a < sample_b")
    return both.groupBy("sample_a", "sample_b").agg(F.avg(F.abs(F.log2("x") - F.log2("y"))).alias("difference"))
