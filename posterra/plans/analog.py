"""A posterior cube made of the driver's star schema.

transcript: (brand, type) · gene and tgroup: brand · sample: (return flag, line status) ·
condition: return flag · draw: quarter of the ship date · value: share of the revenue of a
(draw, sample). Revenue is kept in whole cents and every cell has one added, so sums are
exact, every entity has one row a draw, and no ratio has a zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    rows = part.select(
        F.concat_ws("|", "p_brand", "p_type").alias("transcript_id"), F.col("p_brand").alias("gene_id"), F.col("p_brand").alias("gene_name"),
        F.col("p_brand").alias("seqname"), F.lit("+").alias("strand"), F.lit(0).alias("min_start"), F.lit(0).alias("max_end"), "p_type",
    )
    return annotation.with_gene_tgroup(annotation.with_tid(rows))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).alias("draw"), "l_returnflag", "l_linestatus",
        F.concat_ws("|", "p_brand", "p_type").alias("transcript_id"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, name, condition, condition_name): the pairs of two small flags."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return rows.select(
        (F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus")) - 1).alias("sample"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("name"),
        (F.dense_rank().over(Window.orderBy("l_returnflag")) - 1).alias("condition"), F.col("l_returnflag").alias("condition_name"), "l_returnflag", "l_linestatus",
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, sample, condition, tid, tgroup, gene_id, cents), dense.

    Cells are summed from the lines first; the frame they are laid on is the product of
    three dimensions, as large as the cube itself and no larger.
    """
    lines = _lines(spark, sf_dir)
    cells = lines.groupBy("draw", "l_returnflag", "l_linestatus", "transcript_id").agg(F.sum("cents").alias("cents"))
    frame = cells.select("draw").distinct().crossJoin(samples(spark, sf_dir)).crossJoin(transcripts(spark, sf_dir).select("tid", "transcript_id", "tgroup", "gene_id"))
    dense = frame.join(cells, ["draw", "l_returnflag", "l_linestatus", "transcript_id"], "left")
    return dense.select("draw", "sample", "condition", "tid", "tgroup", "gene_id", (F.coalesce("cents", F.lit(0).cast("long")) + 1).alias("cents"))


def _share(rows: DataFrame, *by: str) -> DataFrame:
    total = F.sum("cents").over(Window.partitionBy(*by))
    return rows.withColumn("value", (F.col("cents").cast("double") / total.cast("double")).cast("float")).drop("cents")


def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(cube(spark, sf_dir).select("draw", "sample", "condition", "tid", "cents"), "draw", "sample")


def _by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).groupBy("draw", "condition", "tid", "tgroup").agg(F.sum("cents").alias("cents"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).groupBy("draw", "tid", "tgroup").agg(F.sum("cents").alias("cents"))


def condition_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(_by_condition(spark, sf_dir).drop("tgroup"), "draw", "condition")


def condition_splice_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(_by_condition(spark, sf_dir), "draw", "condition", "tgroup")


def condition_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, condition, tid, tgroup, mean, mu): both tables of a condition from one cube."""
    rows = _by_condition(spark, sf_dir)
    share = lambda *by: (F.col("cents").cast("double") / F.sum("cents").over(Window.partitionBy(*by)).cast("double")).cast("float")
    return rows.select("draw", "condition", "tid", "tgroup", share("draw", "condition").alias("mean"), share("draw", "condition", "tgroup").alias("mu"))


def experiment_splice_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(_whole(spark, sf_dir), "draw", "tgroup")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature a type: transcripts of the type include it, those of the next type (in name order) exclude it."""
    rows = transcripts(spark, sf_dir).select("tid", "p_type")
    kinds = rows.select("p_type").distinct()
    w = Window.orderBy("p_type")
    kinds = kinds.select("p_type", (F.row_number().over(w) - 1).alias("feature_id"), F.coalesce(F.lead("p_type").over(w), F.min("p_type").over(Window.partitionBy())).alias("next"))
    members = rows.groupBy("p_type").agg(F.sort_array(F.collect_list("tid")).alias("tids"))
    out = kinds.join(members.withColumnRenamed("tids", "including"), "p_type")
    return out.join(members.select(F.col("p_type").alias("next"), F.col("tids").alias("excluding")), "next").select("feature_id", "including", "excluding")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user group a type, its transcripts in tid order."""
    rows = transcripts(spark, sf_dir)
    return rows.select(F.col("p_type").alias("group"), (F.row_number().over(Window.partitionBy("p_type").orderBy("tid")) - 1).alias("position"), "transcript_id")
