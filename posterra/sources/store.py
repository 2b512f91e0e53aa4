"""The posterior store: one Parquet table a quantity, and the tables that go out."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


#: Draws that are written together, and rows of a file.
BATCH, FILE_ROWS = 25, 1 << 22


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table by its schema; filters on its partition column prune files. Of a run that was stopped, only draws that are whole are read."""
    rows = spark.read.schema(schema.STORE[table]).parquet(f"{path}/{table}")
    if "draw" in rows.columns and table != "committed" and _exists(spark, f"{path}/committed"):
        last = spark.read.schema(schema.STORE["committed"]).parquet(f"{path}/committed").agg(F.max("draw")).first()[0]
        return rows.where(F.col("draw") <= (-1 if last is None else last))
    return rows


def write(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append draws (or write a whole table); columns are cast to the schema, rows clustered by transcript."""
    kinds = dict(part.strip().split(" ", 1) for part in schema.STORE[table].split(", "))
    out = df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    if "tid" in kinds and table != "transcripts":
        out = out.sortWithinPartitions("tid", "draw")
    writer = out.write.mode(mode)
    if table in schema.PARTITIONED:
        writer = writer.partitionBy(*schema.PARTITIONED[table])
    writer.parquet(f"{path}/{table}")


class Draws:
    """Draws of a run, which wait until ``batch`` of them are written at once, a job and a few files a table.

    A new run empties the tables. Draws count once all of their tables are written, which the table
    ``committed`` says; what a stopped run leaves of others is not read.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = BATCH, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.batch, self.file_rows = spark, path, batch, file_rows
        self.waiting: dict[str, list[DataFrame]] = {}
        self.draws = 0
        write(spark.createDataFrame([], schema.STORE["committed"]), path, "committed", "overwrite")
        self.fresh = True

    def add(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self.waiting.setdefault(name, []).append(rows)
        self.draws += 1
        if self.draws == self.batch:
            self.flush()

    def flush(self) -> None:
        if not self.draws:
            return
        for name, frames in self.waiting.items():
            rows = reduce(DataFrame.unionByName, frames)
            # the first frame stands for the others, which have as many rows
            files = max(1, -(-frames[0].count() * len(frames) // self.file_rows))
            by = ["tid"] if "tid" in rows.columns else []
            write(rows.repartition(files, *by), self.path, name, "overwrite" if self.fresh else "append")
        draws = reduce(DataFrame.unionByName, [f.select("draw").distinct() for f in self.waiting["scaling"]])
        write(draws.coalesce(1), self.path, "committed")
        self.waiting, self.draws, self.fresh = {}, 0, False


def inflated_floats(column):
    """zlib-deflated float arrays (an older sample format) to arrays."""
    @F.pandas_udf("array<float>")
    def inflate(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(zlib.decompress(b), dtype="<f4"))

    return inflate(column)


#: Column formats of the text output, by name suffix.
FORMATS = {"estimate": "%e", "lower": "%e", "upper": "%e", "down_pr": "%.3f", "up_pr": "%.3f", "rate": "%f", "samples": "%.4f"}


def formatted(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    formats = FORMATS if formats is None else formats
    kinds = dict(df.dtypes)

    def column(c: str):
        form = next((f for suffix, f in formats.items() if c.endswith(suffix)), "%f")
        if kinds[c] in ("double", "float"):
            return F.format_string(form, c).alias(c)
        if kinds[c] in ("array<double>", "array<float>"):
            return F.array_join(F.transform(c, lambda x: F.format_string(form, x)), ",").alias(c)
        return F.col(c)

    return df.select(*[column(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, formats: dict[str, str] | None = None) -> None:
    """Tab-separated text with a header in one file, for readers outside Spark."""
    out = df.orderBy(*order) if order else df
    formatted(out, formats).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def wide(df: DataFrame, keys: list[str], unit: str, names: dict[int, str], values: dict[str, str]) -> DataFrame:
    """One column a (unit, value): ``{name}{suffix}``; names and order of the units are given, not found."""
    picked = [F.max(F.when(F.col(unit) == n, F.col(v))).alias(f"{name}{suffix}") for n, name in names.items() for v, suffix in values.items()]
    return df.groupBy(*keys).agg(*picked)


def write_yaml(path: str, content: dict) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(content, f, sort_keys=False)
