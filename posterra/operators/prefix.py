"""Running sums, ranks and caps over a whole table, in order, without a window that spans it.

Rows are dealt by ranges of the order, summed within their partition and kept in the shared
folder; what each partition comes to (one row a partition) is summed up on the driver and added to the rows behind it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _opens(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the row before in any of the columns; the first does if there are any."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for column in columns:
        before, after = column.slice(0, n - 1), column.slice(1)
        differs = np.asarray(pc.fill_null(pc.not_equal(before, after), False))
        out[1:] |= differs | (np.asarray(before.is_null()) != np.asarray(after.is_null()))
    out[:1] = True
    return out


def _summed(batches: Iterator[pa.RecordBatch], keys: int, sums: int) -> Iterator[pa.RecordBatch]:
    """The last ``sums`` columns become running sums within a task, which begin again where the ``keys`` columns before them change."""
    part, at, carry, last, first = TaskContext.get().partitionId(), 0, np.zeros(sums, dtype=np.int64), None, True
    for batch in batches:
        n, width = batch.num_rows, batch.num_columns
        if not n:
            continue
        own = [batch.column(i) for i in range(width - sums - keys, width - sums)]
        opens = _opens(own) if keys else np.zeros(n, dtype=bool)
        if keys:
            opens[0] = last is not None and last != tuple(c[0].as_py() for c in own)
            last = tuple(c[n - 1].as_py() for c in own)
        run = np.cumsum(opens)
        starts = np.flatnonzero(opens)
        out = []
        for i in range(sums):
            values = np.asarray(batch.column(width - sums + i).fill_null(0))
            total = np.cumsum(values)
            base = np.concatenate(([-carry[i]], (total - values)[starts]))
            out.append(total - base[run])
            carry[i] = out[-1][-1]
        in_first = (run == 0) if first else np.zeros(n, dtype=bool)
        first = first and not opens.any()
        names = [*batch.schema.names[: width - sums], *[f"__sum{i}" for i in range(sums)], "__part", "__at", "__first"]
        columns = [*batch.columns[: width - sums], *map(pa.array, out), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n)), pa.array(in_first)]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        at += n


def running(rows: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with running sums (longs, their own row included), in ``order``, over the table or within ``keys``; a null counts 0.

    Rows that ``order`` leaves equal stand in any order, but always in one partition. What reaches the driver is a row a partition.
    """
    spark = rows.sparkSession
    by = [*map(F.col, keys), *[F.col(c) if isinstance(c, str) else c for c in order]]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    named = ranged.select(*rows.columns, *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"__sum{i}") for i, c in enumerate(sums.values())])
    more = "".join(f", __sum{i} long" for i in range(len(sums)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[: len(named.columns) - len(sums)])
    n_keys, n_sums = len(keys), len(sums)
    local = checkpointed(named.mapInArrow(lambda it: _summed(it, n_keys, n_sums), f"{kinds}{more}, __part int, __at long, __first boolean"))
    key, total = F.struct(*[f"__key{i}" for i in range(len(keys))], F.lit(0).alias("none")), F.struct(*[f"__sum{i}" for i in range(len(sums))])
    ends = local.groupBy("__part").agg(F.min_by(key, "__at").alias("opens"), F.max_by(key, "__at").alias("closes"), F.max_by(total, "__at").alias("total"), F.min("__first").alias("one"))
    carries, carry, before = [], [0] * len(sums), None
    for part in sorted(ends.collect(), key=lambda r: r["__part"]):
        carry = carry if part["opens"] == before else [0] * len(sums)
        carries.append((part["__part"], *carry))
        carry = [a + (b if part["one"] else 0) for a, b in zip(part["total"], carry, strict=True)]
        before = part["closes"]
    added = spark.createDataFrame(carries, "__part int" + "".join(f", __carry{i} long" for i in range(len(sums))))
    out = local.join(F.broadcast(added), "__part")
    value = lambda i: F.col(f"__sum{i}") + F.when(F.col("__first"), F.col(f"__carry{i}")).otherwise(0)
    return out.select(*rows.columns, *[value(i).alias(name) for i, name in enumerate(sums)])


def ranked(rows: DataFrame, order: Sequence[str | Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place in ``order``, from 0."""
    return running(rows, order, {name: F.lit(1)}, keys).withColumn(name, F.col(name) - 1)


def until(rows: DataFrame, order: Sequence[str | Column], size: Column, most: int) -> DataFrame:
    """The first rows in ``order``, up to and with the one whose ``size`` brings the sum to ``most``."""
    return running(rows.withColumn("__size", size.cast("long")), order, {"__upto": F.col("__size")}).where(F.col("__upto") - F.col("__size") < most).drop("__size", "__upto")
