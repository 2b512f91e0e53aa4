"""The reference operators as queries over the driver's tables: (spark, sf_dir) -> DataFrame.

Floating results are rounded at the end of a query only, so that engines which add in
another order give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar, seq
from ..model import bias, densities, gibbs
from ..model import slice as slices
from ..operators import annotation, components, fragments, intervals, prefix, scaling
from . import analog, summaries

LEVEL = 0.95
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    """The kept columns, then every other double rounded; -0 becomes 0."""
    rest = [c for c, kind in df.dtypes if c not in keep and kind == "double"]
    return df.select(*keep, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in rest])


# --- summaries of the posterior cube ------------------------------------------------------------


def _unscaled(spark, d):
    """Draws with the scale of their sample divided out; the scales, a number a draw and sample, are found first."""
    quant = analog.quant(spark, d)
    return summaries.rescaled(quant, scaling.quantile_scale(quant))


@query
def transcript_expression(spark, d):
    out = summaries.transcript_expression(_unscaled(spark, d), None, analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 4, "sample", "tid", "gene_id", "transcript_id")


@query
def transcript_expression_normalized(spark, d):
    out = summaries.transcript_expression(analog.quant(spark, d), None, analog.transcripts(spark, d), LEVEL, normalize=True)
    return _rounded(out, 4, "sample", "tid", "gene_id", "transcript_id")


@query
def transcript_splicing(spark, d):
    return _rounded(summaries.transcript_splicing(analog.quant(spark, d), analog.transcripts(spark, d), LEVEL), 6, "sample", "tid", "transcript_id")


@query
def gene_expression(spark, d):
    out = summaries.gene_expression(_unscaled(spark, d), None, analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 4, "sample", "gene_id", "gene_name", "transcript_ids")


@query
def feature_expression(spark, d):
    return _rounded(summaries.feature_expression(_unscaled(spark, d), None, analog.features(spark, d), LEVEL), 4, "sample", "feature_id")


@query
def condition_transcript_expression(spark, d):
    return _rounded(summaries.condition_transcript_expression(analog.condition_mean(spark, d), analog.transcripts(spark, d), LEVEL), 4, "condition", "tid", "transcript_id")


@query
def condition_gene_expression(spark, d):
    return _rounded(summaries.condition_gene_expression(analog.condition_mean(spark, d), analog.transcripts(spark, d), LEVEL), 4, "condition", "gene_id", "transcript_ids")


@query
def condition_feature_expression(spark, d):
    return _rounded(summaries.condition_feature_expression(analog.condition_mean(spark, d), analog.features(spark, d), LEVEL), 4, "condition", "feature_id")


PAIR = ("condition_a", "condition_b")


@query
def diff_transcript(spark, d):
    out = summaries.differential_transcript_expression(analog.condition_mean(spark, d), analog.transcripts(spark, d), 1.0, LEVEL)
    return _rounded(out, 6, "tid", "transcript_id", *PAIR)


@query
def diff_gene(spark, d):
    return _rounded(summaries.differential_gene_expression(analog.condition_mean(spark, d), analog.transcripts(spark, d), 0.5, LEVEL), 6, "gene_id", "transcript_ids", *PAIR)


@query
def diff_group(spark, d):
    out = summaries.differential_group_expression(analog.condition_mean(spark, d), analog.groups(spark, d), analog.transcripts(spark, d), 0.25, LEVEL)
    return _rounded(out, 6, "group", "gene_ids", "transcript_ids", *PAIR)


@query
def diff_splicing(spark, d):
    out = summaries.differential_splicing(analog.condition_splice_mu(spark, d).drop("tgroup"), analog.transcripts(spark, d), 0.1, LEVEL)
    return _rounded(out, 6, "tid", "tgroup", "transcript_id", *PAIR)


@query
def condition_splicing(spark, d):
    out = summaries.condition_splicing(analog.condition_splice_mu(spark, d).drop("tgroup"), analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 6, "condition", "tid", "tgroup", "transcript_id")


@query
def experiment_splicing(spark, d):
    out = summaries.experiment_splicing(analog.experiment_splice_mu(spark, d).drop("tgroup"), analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 6, "tid", "tgroup", "transcript_id")


@query
def pairwise_splicing(spark, d):
    return _rounded(summaries.pairwise_splicing(analog.condition_splice_mu(spark, d)), 6, "tid", *PAIR)


def _inclusion(spark, d):
    return summaries.inclusion_rate(analog.condition_cells(spark, d), analog.features(spark, d), analog.transcripts(spark, d))


@query
def feature_splicing(spark, d):
    return _rounded(summaries.rate_changes(_inclusion(spark, d), 0.05, LEVEL), 6, "feature_id", *PAIR)


@query
def feature_splicing_samples(spark, d):
    out = summaries.rate_samples(_inclusion(spark, d))
    return out.select("feature_id", "condition", F.posexplode("samples").alias("round", "v")).select("feature_id", "condition", "round", F.round("v", 6).alias("rate"))


@query
def trace(spark, d):
    """The transcript with the first id."""
    t = analog.transcripts(spark, d)
    first = t.agg(F.min("transcript_id")).first()[0]
    return _rounded(summaries.trace(analog.experiment_splice_mu(spark, d), analog.condition_splice_mu(spark, d).drop("tgroup"), t, first), 6, "round", "condition")


@query
def describe(spark, d):
    return summaries.describe(analog.samples(spark, d), analog.transcripts(spark, d))


@query
def expression_samples(spark, d):
    out = summaries.expression_samples(analog.quant(spark, d))
    return out.select("sample", "tid", F.array_join(F.transform("samples", lambda v: F.round(v * 1e9).cast("long").cast("string")), ",").alias("samples"))


@query
def monotone_order(spark, d):
    return _rounded(summaries.ordering_frequency(analog.condition_splice_mu(spark, d), ["tid"], least=0.25), 6, "tid", "ordering")


@query
def switch_divergence(spark, d):
    return _rounded(summaries.switch_divergence(analog.condition_splice_mu(spark, d), analog.transcripts(spark, d)), 6, "tgroup", *PAIR)


@query
def quantile_normalization(spark, d):
    return _rounded(scaling.quantile_scale(analog.quant(spark, d)), 9, "draw", "sample")


@query
def most_abundant(spark, d):
    whole = analog.cube(spark, d).groupBy("sample", "tid").agg(F.sum("cents").alias("cents"))
    return scaling.most_abundant(whole, 10, ("sample",), "cents", ("tid",)).select("sample", "rank", "tid", "cents")


# --- annotation ---------------------------------------------------------------------------------


@query
def tid_assignment(spark, d):
    return analog.transcripts(spark, d).select("transcript_id", "tid")


@query
def tgroup_dense_rank(spark, d):
    return analog.transcripts(spark, d).select("transcript_id", "tgroup")


@query
def spliced_tgroups(spark, d):
    return annotation.spliced_tgroups(analog.transcripts(spark, d)).select("tgroup", "n", "spliced")


@query
def natural_sort(spark, d):
    """Place of each supplier name among all in natural order."""
    names = analog.table(spark, d, "supplier").select(F.col("s_name").alias("seqname")).distinct()
    placed = prefix.ranked(names, [seq.natural_number(F.col("seqname")), "seqname"], "place")
    return placed.select("seqname", (F.col("place") + 1).cast("int").alias("place"))


@query
def tss_cluster(spark, d):
    """Runs of events of a user at most an hour apart."""
    events = analog.table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    out = intervals.with_islands(events.withColumn("end", F.col("at")), ["user_id"], "at", "end", ["event_id"], gap=3600, name="cluster")
    return out.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _shipments(spark, d):
    """Intervals by supplier: from the ship day, as many days as the quantity."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    return analog.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seqname"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))


@query
def locus_grouping(spark, d):
    rows = intervals.with_islands(_shipments(spark, d), ["seqname"], name="locus")
    return rows.groupBy("seqname", "locus").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("min_start"), F.max("end").alias("max_end"))


@query
def interval_union(spark, d):
    return intervals.union(_shipments(spark, d), ["seqname"])


@query
def intergenic_gaps(spark, d):
    return intervals.gaps(_shipments(spark, d), ["seqname"])


@query
def consensus_segments(spark, d):
    return intervals.segments(_shipments(spark, d), ["seqname"])


@query
def introns_flanks(spark, d):
    """Gaps between consecutive shipments of a part."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    rows = analog.table(spark, d, "lineitem").select(F.col("l_partkey").alias("tid"), day.alias("start"), (day + F.col("l_linenumber")).alias("end"))
    return intervals.introns(rows, ["tid"])


def _exons(spark, d):
    """Orders as transcripts: short exons on a grid of twelve places, some as long as two places."""
    start = (F.col("l_partkey") % 12) * 100
    end = start + F.when(F.col("l_linenumber") == 7, 140).otherwise(40)
    order = F.col("l_orderkey")
    rows = analog.table(spark, d, "lineitem").select(
        order.alias("tid"), F.concat(F.lit("chr"), (order % 5).cast("string")).alias("seqname"), F.when(order % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), end.alias("end")
    )
    return rows.distinct()


def _feature_rows(df):
    return df.select("seqname", "strand", "start", "end", "link_start", "link_end", F.size("including").alias("n_including"), F.size("excluding").alias("n_excluding"), F.element_at("including", 1).alias("first_including"))


@query
def cassette_features(spark, d):
    return _feature_rows(annotation.cassette_exons(_exons(spark, d)))


@query
def retained_features(spark, d):
    return _feature_rows(annotation.retained_introns(_exons(spark, d)))


@query
def gene_end_exons(spark, d):
    ends = intervals.gene_ends(_exons(spark, d).withColumn("gene_id", F.col("tid")))
    return ends.select("gene_id", F.col("five_prime.start").alias("five_start"), F.col("five_prime.end").alias("five_end"), F.col("three_prime.start").alias("three_start"), F.col("three_prime.end").alias("three_end"))


@query
def utr_intervals(spark, d):
    return intervals.three_prime_utrs(_exons(spark, d))


@query
def transcript_offsets(spark, d):
    return intervals.transcript_offsets(_exons(spark, d)).select("tid", "start", "end", "offset")


@query
def three_prime_distance(spark, d):
    return fragments.three_prime_distance(_exons(spark, d)).groupBy("tid").agg(F.max("distance").alias("most"), F.sum("distance").alias("total"))


# --- range joins --------------------------------------------------------------------------------


def _timed(spark, d):
    return analog.table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query
def interval_containment(spark, d):
    """Events within six hours after a purchase of the same user."""
    events = _timed(spark, d)
    points = events.select("user_id", "event_id", F.col("at").alias("p_start"), F.col("at").alias("p_end"))
    windows = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("at").alias("w_start"), (F.col("at") + 21600).alias("w_end"))
    return intervals.overlap_join(points, windows, ["user_id"], ("p_start", "p_end"), ("w_start", "w_end"), 21600, contained=True).select("window_id", "event_id")


@query
def interval_overlap(spark, d):
    """Overlapping windows of views (an hour) and clicks (two hours) of a user."""
    events = _timed(spark, d)
    a = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("a_start"), (F.col("at") + 3600).alias("a_end"))
    b = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("at").alias("b_start"), (F.col("at") + 7200).alias("b_end"))
    return intervals.overlap_join(a, b, ["user_id"], ("a_start", "a_end"), ("b_start", "b_end"), 7200).select("view_id", "click_id")


@query
def bounded_asof(spark, d):
    """The latest signup of the user at or before each event."""
    events = _timed(spark, d)
    signups = events.where("event_type = 'signup'").select("user_id", "at", "event_id")
    return intervals.bounded_asof(events, signups.withColumnRenamed("event_id", "signup"), ["user_id"], "at", "signup", "signup_id").select("event_id", "signup_id")


# --- fragments ----------------------------------------------------------------------------------


def _lags(spark, d):
    lines = analog.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag")
    orders = analog.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.abs(F.datediff("l_shipdate", "o_orderdate")).alias("length"), "l_linestatus", "l_returnflag")


@query
def position_tally(spark, d):
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    reads = analog.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seqname"), F.col("l_linestatus").alias("strand"), day.alias("pos"), F.col("l_orderkey").alias("interval_id"))
    return fragments.position_tally(reads)


@query
def fragment_histogram(spark, d):
    return fragments.length_histogram(_lags(spark, d))


@query
def emp_dist(spark, d):
    return _rounded(fragments.empirical_distribution(fragments.length_histogram(_lags(spark, d)), "length", tail=1e-3), 9, "length")


@query
def weighted_median(spark, d):
    return fragments.weighted_median(fragments.length_histogram(_lags(spark, d)), "length")


@query
def strand_entropy(spark, d):
    return _rounded(fragments.strand_entropy(_lags(spark, d), F.col("l_linestatus") == "F"), 9)


@query
def unique_fragment_counts(spark, d):
    return fragments.unique_counts(analog.table(spark, d, "lineitem"), ["l_suppkey"], ["l_linenumber", "l_quantity", "l_discount"])


def _order_brands(spark, d):
    lines = analog.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    part = analog.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id"))
    return lines.join(part, "l_partkey")


@query
def gene_counts(spark, d):
    """Orders of parts of one brand only, by brand."""
    genes = analog.table(spark, d, "part").select(F.col("p_brand").alias("gene_id"))
    return fragments.gene_counts(_order_brands(spark, d), genes, "l_orderkey")


@query
def mate_counts(spark, d):
    flags = analog.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qname"), F.when(F.col("l_linestatus") == "F", 64).otherwise(128).alias("flag"))
    return fragments.mate_counts(flags)


def _weights(spark, d):
    rows = _order_brands(spark, d)
    return rows.select(F.col("gene_id").alias("tid"), F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("seq"), F.col("l_quantity").alias("w"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("align_pr"))


@query
def best_alignment(spark, d):
    return fragments.best_alignment(_weights(spark, d)).select("tid", "read", "w", "align_pr", "seq")


@query
def align_prune(spark, d):
    rows = fragments.prune(_weights(spark, d).groupBy("read", "tid").agg(F.max("align_pr").alias("align_pr")))
    return _rounded(rows, 9, "read", "tid", "align_pr")


@query
def align_sums(spark, d):
    return fragments.alignment_sums(_weights(spark, d).withColumnRenamed("tid", "locus"))


@query
def connected_components(spark, d):
    """Orders and parts tied by any line."""
    edges = analog.table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return components.connected_components(edges)


@query
def connected_components_of_all_lines(spark, d):
    """The same under its former name."""
    return connected_components(spark, d)


# --- sequences, attributes, CIGAR ---------------------------------------------------------------


def _sequences(spark, d):
    return analog.table(spark, d, "documents").select("doc_id", "lang", F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("s"))


@query
def gc_content(spark, d):
    return _sequences(spark, d).select("doc_id", F.length("s").alias("bases"), seq.gc_count(F.col("s")).alias("gc"))


@query
def gc_bias_bins(spark, d):
    rows = _sequences(spark, d).where("length(s) > 0").select("lang", (seq.gc_count(F.col("s")) / F.length("s")).alias("gc"), F.lit(1).alias("weight"))
    return _rounded(fragments.gc_bias(rows.where("lang <=> 'en'"), rows.where("not lang <=> 'en'")), 9, "bin")


@query
def revcomp(spark, d):
    return _sequences(spark, d).select("doc_id", F.md5(seq.reverse_complement(F.col("s"))).alias("revcomp_md5"))


def _kmer_rows(spark, d, k):
    rows = _sequences(spark, d).select("lang", F.posexplode(seq.kmers(F.col("s"), k)).alias("at", "kmer"))
    return rows.select("lang", (F.col("at") % 7).alias("pos"), "kmer")


@query
def kmer_counts(spark, d):
    counts = fragments.kmer_totals(analog.table(spark, d, "documents"), "text", 4)
    return counts.select(seq.kmer_string(F.col("number"), 4).alias("kmer"), "number", "count")


@query
def kmer_conditional(spark, d):
    """Probability of the third letter given the first two, by position modulo seven."""
    counts = _kmer_rows(spark, d, 3).groupBy("pos", "kmer").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy("pos", F.substring("kmer", 1, 2)))
    return _rounded(counts.withColumn("p", share), 9, "pos", "kmer", "count")


@query
def js_divergence(spark, d):
    rows = _kmer_rows(spark, d, 2)
    fore, back = (fragments.kmer_distribution(rows.where(x)) for x in ("lang <=> 'en'", "not lang <=> 'en'"))
    return _rounded(fragments.symmetric_divergence(fore, back), 9, "pos")


@query
def rolling_gc(spark, d):
    """GC pieces among the last five lines of a supplier, where a line is GC if it was returned."""
    rows = analog.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tid"), F.col("l_orderkey").alias("pos")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("gc"))
    return fragments.rolling_gc(rows, 5).select("tid", "pos", "gc_count")


@query
def attribute_map(spark, d):
    part = analog.table(spark, d, "part")
    text = F.format_string('gene_id "%s"; size %s; name "%s"; gene_id "%s";', "p_type", F.col("p_size").cast("string"), "p_name", "p_brand")
    m = seq.attribute_map(text)
    return part.select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["gene_id"].alias("gene_id"), F.col("m")["size"].alias("size"), F.col("m")["name"].alias("name"), F.col("m")["none"].alias("missing"))


@query
def locus_format(spark, d):
    rows = intervals.union(_shipments(spark, d), ["seqname"])
    return rows.select(seq.locus(F.col("seqname").cast("string"), F.col("start"), F.col("end"), F.lit("+")).alias("locus"))


@query
def cigar_ops(spark, d):
    n = lambda c: F.col(c).cast("int").cast("string")
    text = F.concat(n("l_linenumber"), F.lit("S"), n("l_quantity"), F.lit("M"), (F.col("l_suppkey") % 50 + 1).cast("string"), F.lit("N"), (F.col("l_partkey") % 30 + 1).cast("string"), F.lit("M"))
    rows = analog.table(spark, d, "lineitem").select("l_orderkey", text.alias("cigar")).distinct()
    ops = cigar.operations(F.col("cigar"))
    pos = F.col("l_orderkey")
    return rows.select("l_orderkey", "cigar", F.size(ops).alias("n_ops"), cigar.true_position(pos, ops).alias("true_pos"), cigar.true_end(pos, ops).alias("true_end"), cigar.reference_end(pos, ops).alias("ref_end"))


@query
def embedding_dot(spark, d):
    """Inner product of each vector with the next one."""
    v = analog.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    dot = F.aggregate(F.zip_with("embedding", "o", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return _rounded(v.join(other, "vec_id").select("vec_id", dot.alias("dot")), 6, "vec_id")


# --- models: no SQL; tested statistically -------------------------------------------------------


@query
def geometric_mle(spark, d):
    """Rate of a truncated geometric fitted to line numbers."""
    lines = analog.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("tpdist"), F.lit(7).alias("tlen"))
    return spark.createDataFrame([(round(bias.three_prime_rate(lines), 9),)], "rate double")


@query
def slice_sampler(spark, d):
    """One slice update a transcript of its mean expression, given its draws."""
    rows = analog.quant(spark, d).groupBy("tid").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        for b in batches:
            mean, n = b["mean"].to_numpy(), b["n"].to_numpy()
            density = lambda x: densities.gamma_mean(x, mean, n.astype(float))
            yield b.assign(draw=slices.sample(density, mean, 1e-12, 1.0, slices.Counter(gibbs.SEED, 0, b["tid"].to_numpy()), width=mean))[["tid", "draw"]]

    return rows.mapInPandas(run, "tid int, draw double")


@query
def gibbs_round(spark, d):
    """One round of condition and experiment levels over the cube's first draw."""
    quant = analog.quant(spark, d)
    first = quant.agg(F.min("draw")).first()[0]
    values = quant.where(F.col("draw") == first).select("tid", "condition", "sample", F.col("value").cast("double").alias("value"))
    state = values.groupBy("tid", "condition").agg(F.avg("value").alias("mean")).select("tid", "condition", "mean", F.lit(1.0).alias("shape"), F.lit(1e-3).alias("experiment_mean"))
    return gibbs.sample_means(values, state, gibbs.SEED, 0, 1.0, gibbs.Priors())
