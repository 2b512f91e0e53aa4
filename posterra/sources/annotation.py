"""GTF and BED annotation, FASTA sequence, side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.seq import attribute_in, attribute_lists, attribute_map

FLANK = 200


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """All rows of lines (value); places stay 1-based closed. A row without eight fields before the attributes is an error."""
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t", 9)
    bad = F.raise_error(F.concat(F.lit("malformed annotation line: "), F.col("value"))).cast("array<string>")
    rows = lines.select(F.when(F.size(parts) >= 9, parts).when(~F.col("value").startswith("#") & (F.trim("value") != ""), bad).alias("p"))
    value = lambda i: F.when(F.get("p", F.lit(i)) != ".", F.get("p", F.lit(i)))
    return rows.select(
        F.get("p", F.lit(0)).alias("seqname"), F.get("p", F.lit(1)).alias("source"), F.get("p", F.lit(2)).alias("feature"), F.get("p", F.lit(3)).cast("long").alias("start"), F.get("p", F.lit(4)).cast("long").alias("end"),
        F.coalesce(value(5).cast("double"), F.lit(0.0)).alias("score"), F.when(F.get("p", F.lit(6)).isin("+", "-"), F.get("p", F.lit(6))).otherwise(".").alias("strand"),
        F.coalesce(value(7).cast("int"), F.lit(-1)).alias("frame"), attribute_map(F.get("p", F.lit(8))).alias("attributes"), F.get("p", F.lit(8)).alias("attribute_text"),
    )


def exons(gtf: DataFrame, feature: str = "exon", transcript: str = "transcript_id", gene: str = "gene_id") -> DataFrame:
    """Exon rows, 0-based closed; rows of genes and rows without a transcript id are dropped.

    What a transcript is called and where it lies comes from its first row in genomic order; of rows at the same place, the least names.
    A transcript's rows meet once, in a group of its own.
    """
    keys, values = attribute_lists(F.col("attribute_text"))
    place = [F.col("start") - 1, F.col("end") - 1]
    rows = gtf.where(F.col("feature") != "gene").select("seqname", "strand", "source", "feature", place[0].alias("start"), place[1].alias("end"), F.inline(F.array(F.struct(keys.alias("__keys"), values.alias("__values")))))
    attr = lambda k: attribute_in(F.col("__keys"), F.col("__values"), k)
    # a generator, so that the attributes are looked up once and not again for the filter
    named = F.struct(attr(transcript).alias("transcript_id"), attr(gene).alias("gene_id"), attr("gene_name").alias("gene_name"), attr("gene_biotype").alias("biotype"))
    rows = rows.select("seqname", "strand", "source", "feature", "start", "end", F.inline(F.array(named))).where("transcript_id is not null")
    names = ["gene_id", "gene_name", "biotype", "seqname", "strand", "source"]
    own = F.collect_set(F.when(F.col("feature") == feature, F.struct("start", "end")))
    whole = rows.groupBy("transcript_id").agg(F.min(F.struct("start", "end", "feature", *names)).alias("n"), own.alias("own"))
    out = whole.select("transcript_id", *[F.col(f"n.{c}").alias(c) for c in names], F.inline("own"))
    return out.withColumn("gene_name", F.coalesce("gene_name", F.lit("")))


def read_introns(spark: SparkSession, path: str) -> DataFrame:
    return intron_transcripts(spark.read.csv(path, sep="\t", comment="#", schema=schema.BED))


def intron_transcripts(bed: DataFrame) -> DataFrame:
    """Pairs of introns to exon rows of two transcripts, with and without the exon between them; the end of a BED row is exclusive."""
    rows = bed.select("seqname", "start", (F.col("end") - 1).alias("end"), "name", F.coalesce("strand", F.lit(".")).alias("strand"))
    place = F.sort_array(F.collect_list(F.struct("start", "end")))
    pairs = rows.groupBy("name").agg(place.alias("i"), F.count_distinct("seqname", "strand").alias("n"), F.min("seqname").alias("seqname"), F.min("strand").alias("strand"))
    ok = (F.size("i") == 2) & (F.col("n") == 1) & (F.col("i")[1]["start"] > F.col("i")[0]["end"] + 1)
    bad = F.raise_error(F.concat(F.lit("introns must come in pairs on one strand with a gap between: "), F.col("name"))).cast(dict(pairs.dtypes)["i"])
    pairs = pairs.withColumn("i", F.when(F.size("i") == 2, F.when(ok, F.col("i")).otherwise(bad)).otherwise(bad))
    a, b = F.col("i")[0], F.col("i")[1]
    exon = lambda kind, s, e: F.struct(F.concat("name", F.lit(f"-{kind}")).alias("transcript_id"), s.cast("long").alias("start"), e.cast("long").alias("end"))
    left = (F.greatest(a["start"] - FLANK, F.lit(0)), a["start"] - 1)
    right = (b["end"] + 1, b["end"] + FLANK)
    made = F.array(exon("included", *left), exon("included", a["end"] + 1, b["start"] - 1), exon("included", *right), exon("excluded", *left), exon("excluded", *right))
    out = pairs.select(F.col("name").alias("gene_id"), F.col("name").alias("gene_name"), "seqname", "strand", F.inline(made))
    return out.select("transcript_id", "gene_id", "gene_name", F.lit("").alias("biotype"), "seqname", "strand", F.lit("introns").alias("source"), "start", "end")


def read_exon_list(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("exon lists are not yet supported")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.text(path, lineSep=">"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """(seqname, seq) upper case of records (value) without their mark; the name ends at the first white space."""
    records = records.where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seqname"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group, position, transcript_id) of lines of comma-separated ids; blank lines are skipped.

    Lines are numbered by file position: a groups file is a user's list, read on the driver.
    """
    lines = [row.value for row in spark.read.text(path, wholetext=True).collect()]
    rows = [(g, i, t.strip()) for g, line in enumerate(x for text in lines for x in text.splitlines() if x.strip()) for i, t in enumerate(line.split(",")) if t.strip()]
    return spark.createDataFrame(rows, schema.GROUPS)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One sequence name a line."""
    return spark.read.text(path).select(F.trim("value").alias("seqname")).where("seqname <> ''").distinct()
