"""Quantile normalisation of a composition across samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRUNCATION = 100_000
QUANTILE = 0.9


def quantile_scale(values: DataFrame, by: tuple[str, ...] = ("draw",), sample: str = "sample", value: str = "value", truncation: int = TRUNCATION, q: float = QUANTILE) -> DataFrame:
    """(by, sample, scale): anchor of the first sample over the sample's own anchor.

    The anchor is the value at index ``n - m + floor(q * m)`` of the ascending values, with
    m the smaller of n and ``truncation`` (only the most abundant count).
    """
    group = [*by, sample]
    w = Window.partitionBy(*group)
    m = F.least(F.col("n"), F.lit(truncation))
    ranked = values.select(*group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    anchors = ranked.where(F.col("r") == F.col("n") - m + F.floor(F.lit(q) * m)).select(*group, F.col(value).cast("double").alias("anchor"))
    first = anchors.groupBy(*by).agg(F.min_by("anchor", sample).alias("reference")) if by else anchors.agg(F.min_by("anchor", sample).alias("reference"))
    joined = anchors.join(first, list(by)) if by else anchors.crossJoin(F.broadcast(first))
    return joined.select(*group, (F.col("reference") / F.col("anchor")).alias("scale"))


def most_abundant(values: DataFrame, n: int, by: tuple[str, ...], value: str = "value", ties: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
