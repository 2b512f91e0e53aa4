"""Rows joined by what sets they hold, and sparse rows put side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_keys(rows: DataFrame, owner: str | Sequence[str], member: str) -> DataFrame:
    """(owner, size, key): a key that two owners share exactly if their sets of members are equal; an owner may be several columns.

    The key is the digest of the sorted members, each behind its length, so no members can be read as others. A null member is none.
    """
    owner = [owner] if isinstance(owner, str) else list(owner)
    # members are made distinct by a plain aggregation first: sets are then gathered from few rows
    rows = rows.select(*owner, F.col(member).cast("string").alias("__member")).distinct()
    sets = rows.groupBy(*owner).agg(F.sort_array(F.collect_list("__member")).alias("__members"))
    written = F.array_join(F.transform("__members", lambda m: F.concat(F.octet_length(m).cast("string"), F.lit(":"), m)), "")
    return sets.select(*owner, F.size("__members").alias("size"), F.sha2(written, 256).alias("key"))


def join_by_set(left: DataFrame, right: DataFrame, owner: str, member: str) -> DataFrame:
    """(left_owner, right_owner, size, relation): owners of either side with equal sets, and those without a partner.

    ``relation`` is ``same``, ``left`` or ``right``. Owners of one side that share a set all meet its partners.
    """
    a = set_keys(left, owner, member).select(F.col(owner).alias("left_owner"), F.col("size").alias("left_size"), "key")
    b = set_keys(right, owner, member).select(F.col(owner).alias("right_owner"), F.col("size").alias("right_size"), "key")
    relation = F.when(F.col("left_size").isNull(), "right").when(F.col("right_size").isNull(), "left").otherwise("same")
    return a.join(b, "key", "full").select("left_owner", "right_owner", F.coalesce("left_size", "right_size").alias("size"), relation.alias("relation"))


def classes_by_set(rows: DataFrame, in_left: str, owner: str, member: str, value: str) -> DataFrame:
    """(relation, size, n, of_left, of_right): a row for each set that owners of either side hold, where ``in_left`` says the side.

    ``n`` is how many rows ``join_by_set`` has of the set's owners, and ``of_left`` and ``of_right`` what ``value``, a number that an owner's rows
    share, comes to over those rows; the pairs, which grow with the square of the owners, are not made.
    """
    kept = rows.select(F.col(in_left).alias("__left"), F.col(owner).alias("__owner"), F.col(value).cast("decimal(38,0)").alias("__value"), F.col(member).alias("__own")).where("__left is not null")
    keys = set_keys(kept, ["__left", "__owner", "__value"], "__own")
    side = lambda left, name: [F.count_if(F.col("__left") == left).alias(f"__n_{name}"), F.coalesce(F.sum(F.when(F.col("__left") == left, F.col("__value"))), F.lit(0)).alias(f"__of_{name}")]
    met = keys.groupBy("key", "size").agg(*side(True, "left"), *side(False, "right"))
    both = (F.col("__n_left") > 0) & (F.col("__n_right") > 0)
    relation = F.when(both, "same").when(F.col("__n_left") > 0, "left").otherwise("right")
    times = lambda c: F.greatest(F.col(c), F.lit(1)).cast("decimal(19,0)")
    of = lambda name, other: (F.col(f"__of_{name}").cast("decimal(19,0)") * times(f"__n_{other}")).cast("decimal(38,0)").alias(f"of_{name}")
    return met.select(relation.alias("relation"), "size", (times("__n_left") * times("__n_right")).cast("decimal(38,0)").alias("n"), of("left", "right"), of("right", "left"))


def sparse_union(rows: DataFrame, left: str, right: str, name: str = "both") -> DataFrame:
    """Two sparse rows, arrays of (index, value) with distinct indices, as one array ``name`` of (index, left, right), 0 where absent, by index.

    Indices of both are sorted together, where equal ones are neighbours; no element looks any up.
    """
    entry = lambda i, a, b: F.struct(i.alias("index"), a.cast("double").alias("left"), b.cast("double").alias("right"))
    zero = F.lit(0.0)
    a = F.transform(left, lambda x: entry(x["index"], x["value"], zero))
    b = F.transform(right, lambda x: entry(x["index"], zero, x["value"]))
    nothing = F.array().cast("array<struct<index:bigint,left:double,right:double>>")
    # projections of their own: none is put into a lambda and done anew for each element
    rows = rows.withColumn("__both", F.array_sort(F.concat(F.coalesce(a, nothing), F.coalesce(b, nothing))))
    add = lambda x, after: F.when(x["index"] == after["index"], entry(x["index"], x["left"] + after["left"], x["right"] + after["right"])).otherwise(x)
    rows = rows.withColumn("__sums", F.zip_with("__both", F.slice("__both", F.lit(2), F.greatest(F.size("__both"), F.lit(1))), add))
    before = F.concat(F.array(F.lit(None).cast("struct<index:bigint,left:double,right:double>")), F.col("__both"))
    first = F.zip_with("__sums", before, lambda x, y: F.when(y.isNull() | (x["index"] != y["index"]), x))
    return rows.withColumn(name, F.filter(first, lambda x: x.isNotNull())).drop("__both", "__sums")
