"""Transcript numbering, transcription groups, and splice features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import natural_number
from . import intervals, prefix

SITE = ("seqname", "strand")


def transcript_table(exons: DataFrame) -> DataFrame:
    """One row a transcript from exon rows: span, exonic length, sorted distinct exons."""
    keys = ["transcript_id", "gene_id", "gene_name", "seqname", "strand"]
    exon = F.struct("start", "end")
    out = exons.groupBy(*keys).agg(F.min("start").alias("min_start"), F.max("end").alias("max_end"), F.sort_array(F.collect_set(exon)).alias("exons"))
    return out.withColumn("exonic_length", exonic_length(F.col("exons")))


def exonic_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda acc, e: acc + e["end"] - e["start"] + 1)


def with_tid(transcripts: DataFrame) -> DataFrame:
    """Number transcripts from 0 in natural order.

    The order is total over the annotation, a table bounded by the genome; it is ranked
    within sequences and the sequences' sizes are added, so no window spans the table.
    """
    within = Window.partitionBy("seqname").orderBy("min_start", "max_end", "strand", "gene_id", "gene_name", "transcript_id")
    ranked = transcripts.withColumn("__r", F.row_number().over(within))
    sizes = transcripts.groupBy("seqname").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(natural_number(F.col("seqname")), "seqname").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("seqname", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"))
    return ranked.join(before, "seqname").withColumn("tid", (F.col("__before") + F.col("__r") - 1).cast("int")).drop("__r", "__before")


def with_gene_tgroup(transcripts: DataFrame) -> DataFrame:
    """tgroup = rank of the gene among all genes, from 0."""
    genes = transcripts.select("gene_id").distinct().withColumn("tgroup", F.row_number().over(Window.orderBy("gene_id")) - 1)
    return transcripts.join(genes, "gene_id")


def with_tss_tgroup(transcripts: DataFrame, distance: int = 150) -> DataFrame:
    """tgroup = run of transcripts of a strand whose start sites lie within ``distance`` of the one before.

    Transcripts no longer than ``distance`` are groups of their own.
    """
    tss = F.when(F.col("strand") == "-", -F.col("max_end")).otherwise(F.col("min_start"))
    long = F.col("exonic_length") > distance
    w = Window.partitionBy("seqname", "strand").orderBy("__tss", "tid")
    rows = transcripts.withColumn("__tss", tss)
    opens = F.when(long & F.lag(long).over(w) & (F.col("__tss") - F.lag("__tss").over(w) <= distance), 0).otherwise(1)
    rows = rows.withColumn("__o", opens).withColumn("__run", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("seqname", "strand", "__run").agg(F.min("tid").alias("__least"))
    numbered = prefix.ranked(runs, ["__least"], "tgroup").withColumn("tgroup", F.col("tgroup").cast("int")).drop("__least")
    return rows.join(numbered, ["seqname", "strand", "__run"]).drop("__tss", "__o", "__run")


def spliced_tgroups(transcripts: DataFrame) -> DataFrame:
    """tgroups with two transcripts or more, numbered ascending."""
    groups = transcripts.groupBy("tgroup").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return prefix.ranked(groups, ["tgroup"], "spliced").withColumn("spliced", F.col("spliced").cast("int"))


def within_tgroup(transcripts: DataFrame) -> DataFrame:
    """Index of each transcript in its tgroup."""
    return transcripts.withColumn("index", F.row_number().over(Window.partitionBy("tgroup").orderBy("tid")) - 1)


def _features(including: DataFrame, excluding: DataFrame, kind: str) -> DataFrame:
    """including: (site, start, end, link_start, link_end, tid); excluding: (site, link_start, link_end, tid)."""
    keys = [*SITE, "start", "end"]
    link = [*SITE, "link_start", "link_end"]
    with_ = including.groupBy(*keys, "link_start", "link_end").agg(F.sort_array(F.collect_set("tid")).alias("including"))
    without = excluding.groupBy(*link).agg(F.sort_array(F.collect_set("tid")).alias("excluding"))
    return with_.join(without, link).select(*keys, F.lit(kind).alias("type"), "including", "excluding", "link_start", "link_end")


def cassette_exons(exons: DataFrame) -> DataFrame:
    """Exons whose flanking introns, taken as one, are an intron of another transcript."""
    inner = intervals.flanked_exons(exons).withColumnsRenamed({"left_start": "link_start", "right_end": "link_end"})
    skipping = intervals.introns(exons).withColumnsRenamed({"start": "link_start", "end": "link_end"})
    return _features(inner, skipping, "cassette_exon")


def retained_introns(exons: DataFrame) -> DataFrame:
    """Introns that lie within one exon of another transcript which spans both neighbouring exons."""
    pairs = intervals.adjacent_pairs(exons)
    spliced = pairs.select(*SITE, (F.col("end") + 1).alias("start"), (F.col("start2") - 1).alias("end"), F.col("start").alias("link_start"), F.col("end2").alias("link_end"), "tid")
    whole = exons.select(*SITE, F.col("start").alias("link_start"), F.col("end").alias("link_end"), "tid")
    found = _features(spliced.where("start <= end"), whole, "retained_intron")
    swapped = {"including": F.col("excluding"), "excluding": F.col("including")}
    return found.select(*[swapped.get(c, F.col(c)).alias(c) for c in found.columns])


def features(exons: DataFrame) -> DataFrame:
    """Both kinds; ``feature_id`` is their order by kind and place."""
    both = cassette_exons(exons).unionByName(retained_introns(exons))
    order = ["type", "seqname", "strand", "start", "end", "link_start", "link_end"]
    return prefix.ranked(both, order, "feature_id").withColumn("feature_id", F.col("feature_id").cast("int"))
