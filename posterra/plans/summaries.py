"""Summaries of a cube of posterior draws, as long tables.

Inputs: quant (draw, sample, tid, value), scaling (draw, sample, scale), transcripts (tid,
transcript_id, gene_id, gene_name, tgroup), condition tables (draw, condition, tid, value).
Every entity must have one row a draw: the rank picks depend on the number of draws. Wide
columns and number formats belong to the sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bounds, change_tails, clamp01, draws, fold_tails, log2_fold_change, log_sum_exp, logaddexp, nearest_rank, safe_ln, safe_log2, truncated_rank, upper_median
from ..operators import sets

MILLION = 1e6


def rescaled(quant: DataFrame, scaling: DataFrame | None, normalize: bool = False) -> DataFrame:
    """Draws as doubles; unless ``normalize``, the scale that normalised them is divided out."""
    value = F.col("value").cast("double")
    if normalize or scaling is None:
        return quant.withColumn("value", value)
    return quant.join(scaling, ["draw", "sample"]).withColumn("value", value / F.col("scale")).drop("scale")


def shares(quant: DataFrame, transcripts: DataFrame, unit: str = "sample") -> DataFrame:
    """Draw-wise share of each transcript in its tgroup; tgroups of one transcript are left out."""
    rows = quant.join(transcripts.select("tid", "tgroup"), "tid")
    w = Window.partitionBy("draw", unit, "tgroup")
    total, n = F.sum("value").over(w), F.count(F.lit(1)).over(w)
    return rows.withColumns({"__n": n, "value": F.col("value").cast("double") / total}).where("__n > 1").drop("__n")


def _summary(values: DataFrame, keys: Sequence[str], credible: float | None, factor: float, clamp: bool, center: str = "mean") -> DataFrame:
    rows = values.groupBy(*keys).agg(draws("value").alias("v"), F.avg("value").alias("mean"))
    middle = F.col("mean") if center == "mean" else upper_median(F.col("v"))
    out = [(middle * factor).alias("estimate")]
    if credible is not None:
        lo, hi = (nearest_rank(F.col("v"), q) for q in bounds(credible))
        if clamp:
            lo, hi = F.least(lo, middle), F.greatest(hi, middle)
        out += [(lo * factor).alias("lower"), (hi * factor).alias("upper")]
    return rows.select(*keys, *out)


def _names(transcripts: DataFrame, by: str) -> DataFrame:
    """Gene name (the last transcript's) and transcript ids in tid order, by gene or tgroup."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tid", "transcript_id"))), lambda x: x["transcript_id"]), ",")
    return transcripts.groupBy(by).agg(F.max_by("gene_name", "tid").alias("gene_name"), ids.alias("transcript_ids"))


def transcript_expression(quant: DataFrame, scaling: DataFrame, transcripts: DataFrame, credible: float | None = None, normalize: bool = False) -> DataFrame:
    out = _summary(rescaled(quant, scaling, normalize), ["sample", "tid"], credible, MILLION, True)
    return out.join(transcripts.select("tid", "gene_name", "gene_id", "transcript_id"), "tid")


def transcript_splicing(quant: DataFrame, transcripts: DataFrame, credible: float | None = None) -> DataFrame:
    out = _summary(shares(quant, transcripts), ["sample", "tid"], credible, 1.0, True)
    return out.join(transcripts.select("tid", "gene_name", "gene_id", "transcript_id"), "tid")


def gene_values(values: DataFrame, transcripts: DataFrame, unit: str) -> DataFrame:
    rows = values.join(transcripts.select("tid", "gene_id"), "tid")
    return rows.groupBy("draw", unit, "gene_id").agg(F.sum(F.col("value").cast("double")).alias("value"))


def gene_expression(quant: DataFrame, scaling: DataFrame, transcripts: DataFrame, credible: float | None = None, normalize: bool = False) -> DataFrame:
    values = gene_values(rescaled(quant, scaling, normalize), transcripts, "sample")
    return _summary(values, ["sample", "gene_id"], credible, MILLION, True).join(_names(transcripts, "gene_id"), "gene_id")


def feature_values(values: DataFrame, features: DataFrame, unit: str) -> DataFrame:
    """Sum over the including transcripts of each feature; features: (feature_id, including)."""
    members = features.select("feature_id", F.explode("including").alias("tid"))
    return values.join(members, "tid").groupBy("draw", unit, "feature_id").agg(F.sum(F.col("value").cast("double")).alias("value"))


def feature_expression(quant: DataFrame, scaling: DataFrame, features: DataFrame, credible: float | None = None, normalize: bool = False, compat: bool = False) -> DataFrame:
    """``compat`` leaves out the factor of a million, as the format's first writer did."""
    values = feature_values(rescaled(quant, scaling, normalize), features, "sample")
    return _summary(values, ["sample", "feature_id"], credible, 1.0 if compat else MILLION, True)


def condition_transcript_expression(mean: DataFrame, transcripts: DataFrame, credible: float | None = None) -> DataFrame:
    out = _summary(rescaled(mean, None), ["condition", "tid"], credible, MILLION, False)
    return out.join(transcripts.select("tid", "gene_name", "gene_id", "transcript_id"), "tid")


def condition_gene_expression(mean: DataFrame, transcripts: DataFrame, credible: float | None = None) -> DataFrame:
    return _summary(gene_values(mean, transcripts, "condition"), ["condition", "gene_id"], credible, MILLION, False).join(_names(transcripts, "gene_id"), "gene_id")


def condition_feature_expression(mean: DataFrame, features: DataFrame, credible: float | None = None, compat: bool = False) -> DataFrame:
    return _summary(feature_values(mean, features, "condition"), ["condition", "feature_id"], credible, 1.0 if compat else MILLION, False)


def pairwise(values: DataFrame, keys: Sequence[str], change: Column, tails, effect: float, credible: float | None, ordered: bool = True) -> DataFrame:
    """Every pair of conditions a < b: tail probabilities, upper median and bounds of ``change`` over draws.

    ``change`` is a column of ``a`` and ``b``, the two conditions' values in one draw. All
    conditions of a draw are gathered by one grouping, pairs come from that array, so the
    draws are shuffled once and not joined with themselves.
    """
    seen = values.groupBy(*keys, "draw").agg(F.sort_array(F.collect_list(F.struct("condition", "value"))).alias("c"))
    first = seen.select(*keys, "draw", "c", F.explode("c").alias("x"))
    both = first.select(*keys, "draw", F.col("x.condition").alias("condition_a"), F.col("x.value").alias("a"), F.explode("c").alias("y"))
    both = both.where(F.col("condition_a") < F.col("y.condition") if ordered else F.col("condition_a") != F.col("y.condition"))
    both = both.select(*keys, "draw", "condition_a", F.col("y.condition").alias("condition_b"), "a", F.col("y.value").alias("b"))
    both = both.withColumn("x", change)
    up, down = tails(F.col("x"), effect)
    rows = both.groupBy(*keys, "condition_a", "condition_b").agg(F.avg(down).alias("down_pr"), F.avg(up).alias("up_pr"), draws("x").alias("v"))
    out = [upper_median(F.col("v")).alias("median_change")]
    if credible is not None:
        lo, hi = bounds(credible)
        out += [nearest_rank(F.col("v"), lo).alias("lower_change"), nearest_rank(F.col("v"), hi).alias("upper_change")]
    return rows.select(*keys, "condition_a", "condition_b", "down_pr", "up_pr", *out)


def _fold() -> Column:
    return log2_fold_change(F.col("a"), F.col("b"))


def differential_transcript_expression(mean: DataFrame, transcripts: DataFrame, effect: float = 1.0, credible: float | None = None) -> DataFrame:
    out = pairwise(rescaled(mean, None), ["tid"], _fold(), fold_tails, effect, credible)
    return out.join(transcripts.select("tid", "gene_name", "gene_id", "transcript_id"), "tid")


def differential_gene_expression(mean: DataFrame, transcripts: DataFrame, effect: float = 1.0, credible: float | None = None) -> DataFrame:
    return pairwise(gene_values(mean, transcripts, "condition"), ["gene_id"], _fold(), fold_tails, effect, credible).join(_names(transcripts, "gene_id"), "gene_id")


def group_members(groups: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(group, position, tid) of user groups; an id the annotation does not have is an error."""
    joined = groups.join(transcripts.select("transcript_id", "tid"), "transcript_id", "left")
    missing = F.raise_error(F.concat(F.lit("no such transcript: "), F.col("transcript_id")))
    return joined.select("group", "position", "transcript_id", F.when(F.col("tid").isNull(), missing.cast("int")).otherwise(F.col("tid")).alias("tid"))


def differential_group_expression(mean: DataFrame, groups: DataFrame, transcripts: DataFrame, effect: float = 1.0, credible: float | None = None) -> DataFrame:
    members = group_members(groups, transcripts)
    values = mean.join(members.select("group", "tid"), "tid").groupBy("draw", "condition", "group").agg(F.sum(F.col("value").cast("double")).alias("value"))
    out = pairwise(values, ["group"], _fold(), fold_tails, effect, credible)
    info = members.join(transcripts.select("tid", "gene_id", "gene_name"), "tid")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "transcript_id"))), lambda x: x["transcript_id"]), ",")
    return out.join(info.groupBy("group").agg(joined("gene_name").alias("gene_names"), joined("gene_id").alias("gene_ids"), ids.alias("transcript_ids")), "group")


def clamped(mu: DataFrame) -> DataFrame:
    return mu.withColumn("value", clamp01(F.col("value").cast("double")))


def differential_splicing(mu: DataFrame, transcripts: DataFrame, effect: float = 0.2, credible: float | None = None) -> DataFrame:
    out = pairwise(clamped(mu), ["tid"], F.col("a") - F.col("b"), change_tails, effect, credible)
    return out.join(transcripts.select("tid", "tgroup", "gene_name", "gene_id", "transcript_id"), "tid")


def condition_splicing(mu: DataFrame, transcripts: DataFrame, credible: float | None = None) -> DataFrame:
    out = _summary(clamped(mu), ["condition", "tid"], credible, 1.0, False, "median")
    return out.join(transcripts.select("tid", "tgroup", "transcript_id"), "tid")


def experiment_splicing(mu: DataFrame, transcripts: DataFrame, credible: float | None = None) -> DataFrame:
    """Also for the experiment's splice sigma: medians as stored, not clamped."""
    out = _summary(mu.withColumn("value", F.col("value").cast("double")), ["tid"], credible, 1.0, False, "median")
    return out.join(transcripts.select("tid", "tgroup", "transcript_id"), "tid")


experiment_splicing_sigma = experiment_splicing


def pairwise_splicing(mu: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """All ordered pairs of conditions: truncated quantiles of the log2 ratio."""
    values = mu.withColumn("value", safe_log2(F.col("value").cast("double")))
    both = values.select("draw", "tid", F.col("condition").alias("condition_a"), F.col("value").alias("a")).join(
        values.select("draw", "tid", F.col("condition").alias("condition_b"), F.col("value").alias("b")), ["draw", "tid"]
    )
    both = both.where("condition_a <> condition_b").groupBy("tid", "condition_a", "condition_b").agg(draws(F.col("a") - F.col("b")).alias("v"))
    return both.select("tid", "condition_a", "condition_b", truncated_rank(F.col("v"), low).alias("lower"), truncated_rank(F.col("v"), high).alias("upper"))


def feature_splicing_rate(mean: DataFrame, mu: DataFrame, features: DataFrame, transcripts: DataFrame, compat: bool = False) -> DataFrame:
    """(draw, condition, feature_id, value): rate of inclusion, see ``inclusion_rate``."""
    cells = mean.select("draw", "condition", "tid", F.col("value").alias("mean")).join(mu.select("draw", "condition", "tid", F.col("value").alias("mu")), ["draw", "condition", "tid"])
    return inclusion_rate(cells.join(transcripts.select("tid", "tgroup"), "tid"), features, transcripts, compat)


def inclusion_rate(cells: DataFrame, features: DataFrame, transcripts: DataFrame, compat: bool = False) -> DataFrame:
    """(draw, condition, feature_id, value) of cells (draw, condition, tid, tgroup, mean, mu).

    Over the tgroups that both include and exclude a feature, the log of the tgroup's mean
    weights each transcript's log splice rate; each tgroup counts once in the denominator.
    With ``compat`` the mean itself is taken for a logarithm and a tgroup counts once for
    each of its transcripts.
    """
    side = lambda name: features.select("feature_id", F.explode(name).alias("tid"), F.lit(name).alias("side"))
    members = side("including").unionByName(side("excluding")).join(transcripts.select("tid", "tgroup"), "tid")
    own = Window.partitionBy("feature_id", "tgroup")
    both = F.size(F.collect_set("side").over(own)) == 2
    times = F.count(F.lit(1)).over(Window.partitionBy("feature_id", "tgroup", "side"))
    members = members.select("feature_id", "tid", "side", both.alias("both"), times.alias("times")).where("both").drop("both")
    total = F.sum(F.col("mean").cast("double")).over(Window.partitionBy("draw", "condition", "tgroup"))
    weighed = cells.withColumn("m", total).select("draw", "condition", "tid", safe_ln(clamp01(F.col("mu").cast("double"))).alias("rate"), (F.col("m") if compat else safe_ln(F.col("m"))).alias("w"))
    rows = weighed.join(members, "tid")
    once = F.col("w") if compat else F.col("w") - F.ln("times")
    value = rows.groupBy("feature_id", "draw", "condition", "side").agg((log_sum_exp(F.col("rate") + F.col("w")) - log_sum_exp(once)).alias("l"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("l")))
    pair = value.groupBy("feature_id", "draw", "condition").agg(pick("including").alias("i"), pick("excluding").alias("o"))
    none = (F.col("i") == float("-inf")) & (F.col("o") == float("-inf"))
    return pair.select("feature_id", "draw", "condition", F.when(none, 0.5).otherwise(F.exp(F.col("i") - logaddexp(F.col("i"), F.col("o")))).alias("value"))


def differential_feature_splicing(mean: DataFrame, mu: DataFrame, features: DataFrame, transcripts: DataFrame, effect: float = 0.2, credible: float | None = None, compat: bool = False) -> DataFrame:
    return rate_changes(feature_splicing_rate(mean, mu, features, transcripts, compat), effect, credible)


def rate_changes(rates: DataFrame, effect: float = 0.2, credible: float | None = None) -> DataFrame:
    return pairwise(rates, ["feature_id"], F.col("a") - F.col("b"), change_tails, effect, credible)


def condition_feature_splicing_samples(mean: DataFrame, mu: DataFrame, features: DataFrame, transcripts: DataFrame, compat: bool = False) -> DataFrame:
    """(feature_id, condition, samples): all draws of the rate in draw order."""
    return rate_samples(feature_splicing_rate(mean, mu, features, transcripts, compat))


def rate_samples(rates: DataFrame) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct("draw", "value"))), lambda x: x["value"])
    return rates.groupBy("feature_id", "condition").agg(listed.alias("samples"))


def trace(experiment_mu: DataFrame, condition_mu: DataFrame, transcripts: DataFrame, transcript_id: str) -> DataFrame:
    """(round, condition, value) of one transcript; condition -1 is the experiment."""
    one = transcripts.where(F.col("transcript_id") == transcript_id).select("tid")
    both = experiment_mu.select("draw", F.lit(-1).alias("condition"), "tid", F.col("value").cast("double").alias("value")).unionByName(clamped(condition_mu).select("draw", "condition", "tid", "value"))
    return both.join(one, "tid", "left_semi").select((F.col("draw") + 1).alias("round"), "condition", "value")


def describe(samples: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row of sizes."""
    s = samples.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("condition").alias("n_conditions"))
    t = transcripts.agg(F.count(F.lit(1)).alias("n_transcripts"), F.count_distinct("gene_id").alias("n_genes"), F.count_distinct("tgroup").alias("n_tgroups"))
    return s.crossJoin(t)


def files_by_condition(samples: DataFrame) -> DataFrame:
    return samples.groupBy("condition_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "filename"))), lambda x: x["filename"]).alias("files"))


def expression_samples(quant: DataFrame, scaling: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """(sample, tid, samples): all raw draws in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("draw", "value"))), lambda x: x["value"])
    return rescaled(quant, scaling, normalize).groupBy("sample", "tid").agg(listed.alias("samples"))


def ordering_frequency(rates: DataFrame, keys: Sequence[str], classes: dict[int, int] | None = None, least: float = 0.5) -> DataFrame:
    """Orders of conditions by value that hold in more than ``least`` of the draws.

    ``classes`` merges conditions of one time point; its conditions' order among themselves is ignored.
    """
    label = F.col("condition")
    if classes:
        mapping = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
        label = F.coalesce(mapping[F.col("condition")], F.col("condition"))
    order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("value", label.alias("label")))), lambda x: x["label"].cast("string")), "<")
    by_draw = rates.groupBy(*keys, "draw").agg(order.alias("ordering"))
    n = F.count(F.lit(1))
    counted = by_draw.groupBy(*keys, "ordering").agg(n.alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("frequency", share).where(F.col("frequency") > least).drop("n")


def switch_divergence(mu: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(tgroup, condition_a, condition_b, divergence): median over draws of the symmetric KL of splice rates."""
    rows = clamped(mu).join(transcripts.select("tid", "tgroup"), "tid") if "tgroup" not in mu.columns else clamped(mu)
    a = rows.select("draw", "tgroup", "tid", F.col("condition").alias("condition_a"), F.col("value").alias("p"))
    b = rows.select("draw", "tid", F.col("condition").alias("condition_b"), F.col("value").alias("q"))
    both = a.join(b, ["draw", "tid"]).where("condition_a < condition_b")
    term = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("p") - F.col("q")) * (F.log2("p") - F.log2("q"))).otherwise(F.lit(0.0))
    by_draw = both.groupBy("tgroup", "condition_a", "condition_b", "draw").agg(F.sum(term).alias("value"))
    return by_draw.groupBy("tgroup", "condition_a", "condition_b").agg(upper_median(draws("value")).alias("divergence"))


def compared_stores(left: DataFrame, right: DataFrame) -> DataFrame:
    """(gene_id, relation, size, log2_ratio) of two runs' (draw, gene_id, transcript_id, value).

    A gene of one set of transcripts in both runs is ``same`` and has the median over draws of the ratio of its
    expression; one whose sets differ is ``different``, and one of a single run ``left`` or ``right``.
    """
    keys = lambda rows, side: sets.set_keys(rows, "gene_id", "transcript_id").select("gene_id", F.col("size").alias(f"{side}_size"), F.col("key").alias(f"{side}_key"))
    met = keys(left, "left").join(keys(right, "right"), "gene_id", "full")
    relation = F.when(F.col("left_key").isNull(), "right").when(F.col("right_key").isNull(), "left").when(F.col("left_key") == F.col("right_key"), "same").otherwise("different")
    met = met.select("gene_id", relation.alias("relation"), F.coalesce("left_size", "right_size").alias("size"))
    total = lambda rows, name: rows.groupBy("gene_id", "draw").agg(F.sum("value").cast("double").alias(name))
    ratio = total(left, "a").join(total(right, "b"), ["gene_id", "draw"]).select("gene_id", (F.log2("a") - F.log2("b")).alias("value"))
    ratio = ratio.groupBy("gene_id").agg(upper_median(draws("value")).alias("ratio"))
    return met.join(ratio, "gene_id", "left").select("gene_id", "relation", "size", F.when(F.col("relation") == "same", F.col("ratio")).alias("log2_ratio"))
