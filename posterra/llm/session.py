"""What the operators need of the session: a shared folder, partition counts, released shuffle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpointed, release, shared_checkpoints

__all__ = ["checkpointed", "numbered", "partitions", "release", "shared_checkpoints"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called c0, c1 and so on, which no operator's own columns are, and what ``names`` are called there."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(n)}" for n in names]
