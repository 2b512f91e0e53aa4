"""Running posterior summaries and sessions over unbounded input (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def draws(spark: SparkSession, path: str, table: str = "quant", files_per_trigger: int = 8) -> DataFrame:
    """A store's table as a stream of the files that the sampler appends."""
    return spark.readStream.schema(schema.STORE[table]).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/{table}")


def running_mean(stream: DataFrame, keys: tuple[str, ...] = ("sample", "tid")) -> DataFrame:
    """Number of draws, mean and spread so far; state is three sums a key."""
    v = F.col("value").cast("double")
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def clusters(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of rows of a key at most ``gap`` apart; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Every batch overwrites the summary, so a repeated batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).start()
