"""Alignment flags and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2 = 1, 2, 4, 8, 16, 32, 64, 128


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def operations(cigar: Column) -> Column:
    """Array of (op, len); ``*`` is empty."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda acc, o: acc + o["len"])


def true_position(pos: Column, ops: Column) -> Column:
    """Position less all operations before the first M."""
    first = F.coalesce(F.array_position(F.transform(ops, lambda o: o["op"]), "M"), F.lit(0)).cast("int")
    leading = F.when(first > 0, F.slice(ops, 1, F.greatest(first - 1, F.lit(0)))).otherwise(ops)
    return pos - F.aggregate(leading, F.lit(0), lambda acc, o: acc + o["len"])


def true_end(pos: Column, ops: Column) -> Column:
    """Exclusive end: true position plus the lengths of M, D, N and S."""
    return true_position(pos, ops) + _total(ops, "MDNS")


def reference_end(pos: Column, ops: Column) -> Column:
    """Exclusive end on the reference: M, D, N, = and X."""
    return pos + _total(ops, "MDN=X")


def placed(pos: Column, ops: Column) -> Column:
    """(op, start, end) closed, each operation where the last one ended."""
    start = F.struct(true_position(pos, ops).alias("at"), F.array().cast("array<struct<op:string,start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        size = F.when(o["op"].isin("M", "D", "N", "S", "=", "X"), o["len"]).otherwise(0)
        item = F.struct(o["op"].alias("op"), acc["at"].cast("bigint").alias("start"), (acc["at"] + size - 1).cast("bigint").alias("end"))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def soft_clips(ops: Column) -> tuple[Column, Column]:
    """Soft-clipped lengths at the left and right end."""
    of = lambda o: F.when(o["op"] == "S", o["len"]).otherwise(0)
    return F.coalesce(of(F.try_element_at(ops, F.lit(1))), F.lit(0)), F.coalesce(of(F.try_element_at(ops, F.lit(-1))), F.lit(0))


def mismatches(tags: Column, md: Column) -> Column:
    """Mismatches by the MD string (deletions skipped), else NM, else nM, else 0."""
    by_md = F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Z]+", ""), "[^A-Z]", ""))
    return F.coalesce(by_md, F.try_element_at(tags, F.lit("NM")).try_cast("int"), F.try_element_at(tags, F.lit("nM")).try_cast("int"), F.lit(0))


def misaligned_probability(n_mismatch: Column, length: Column, aligned: float = 0.01, misaligned: float = 0.05, prior: float = 0.05) -> Column:
    """Posterior probability that an alignment with so many mismatches is a false one."""
    log_wrong = F.log(F.lit(prior)) + n_mismatch * F.log(F.lit(misaligned)) + (length - n_mismatch) * F.log(F.lit(1 - misaligned))
    log_right = F.log(F.lit(1 - prior)) + n_mismatch * F.log(F.lit(aligned)) + (length - n_mismatch) * F.log(F.lit(1 - aligned))
    return 1 / (1 + F.exp(log_right - log_wrong))


def aligned_blocks(pos: Column, ops: Column) -> Column:
    """(start, end) closed runs of reference bases between skips; deletions belong to their run."""
    kind = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(pos.cast("bigint").alias("at"), pos.cast("bigint").alias("from"), F.array().cast(kind).alias("out"))
    closed = lambda acc: F.when(acc["at"] > acc["from"], F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), (acc["at"] - 1).alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, o: Column) -> Column:
        skip = o["op"] == "N"
        size = F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0)
        at = acc["at"] + size
        return F.struct(at.alias("at"), F.when(skip, at).otherwise(acc["from"]).alias("from"), F.when(skip, closed(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ops, start, step, closed)
