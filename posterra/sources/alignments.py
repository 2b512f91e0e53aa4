"""SAM text, and either of SAM and BAM."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import head_of, read_bam

#: Symbolic flags of old SAM files.
FLAG_LETTERS = {"p": 1, "P": 2, "u": 4, "U": 8, "r": 16, "R": 32, "1": 64, "2": 128, "s": 256, "f": 512, "d": 1024}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Records of lines (value) of SAM text; positions become 0-based, ``*`` stays as it is."""
    lines = lines.where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    fields = F.split("value", "\t")
    p = lambda i: F.get(fields, F.lit(i))
    letters = F.create_map(*[F.lit(x) for pair in FLAG_LETTERS.items() for x in pair])
    symbolic = F.aggregate(F.filter(F.split(p(1), ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc.bitwiseOR(F.coalesce(F.try_element_at(letters, c), F.lit(0))))
    flag = F.coalesce(p(1).try_cast("int"), F.when(p(1).startswith("0x"), F.conv(F.substring(p(1), 3, 16), 16, 10).try_cast("int")), symbolic)
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value"))
    seq, qual, cigar = p(9), p(10), p(5)
    by_cigar = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIS=X]"), F.lit(1)), F.lit(0), lambda acc, n: acc + n.cast("int"))
    wrong = ((seq != "*") & (qual != "*") & (F.length(seq) != F.length(qual))) | ((seq != "*") & (cigar != "*") & (F.length(seq) != by_cigar))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("sequence, quality and CIGAR disagree: "), p(0)))).otherwise(p(0))
    lines = lines.where((F.size(fields) >= 11) | F.raise_error(F.concat(F.lit("too few fields: "), F.col("value"))).isNotNull())
    return lines.select(
        checked.alias("qname"), flag.alias("flag"), p(2).alias("rname"), (p(3).cast("long") - 1).alias("pos"), p(4).cast("int").alias("mapq"), cigar.alias("cigar"),
        F.when(p(6) == "=", p(2)).otherwise(p(6)).alias("rnext"), (p(7).cast("long") - 1).alias("pnext"), p(8).cast("long").alias("tlen"), seq.alias("seq"), qual.alias("qual"),
        F.map_from_entries(F.transform(F.slice(fields, 12, 1 << 20), tag)).alias("tags"),
    )


def is_bam(head: bytes) -> bool:
    if head[:2] != b"\x1f\x8b":
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 4) == b"BAM\1"
    except zlib.error:
        return False


def is_sam(head: bytes) -> bool:
    """Whether text looks like SAM: a header line or eleven tab-separated fields."""
    try:
        line = head.decode("utf-8").split("\n", 1)[0]
    except UnicodeDecodeError:
        return False
    fields = line.split("\t")
    return line[:3] in ("@HD", "@SQ", "@RG", "@PG", "@CO") or (len(fields) >= 11 and fields[3].lstrip("-").isdigit())


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """BAM or SAM, told apart by the first bytes."""
    head = head_of(spark, path, 8192)
    if is_bam(head):
        return read_bam(spark, path)
    if is_sam(head):
        return read_sam(spark, path)
    raise ValueError(f"neither BAM nor SAM: {path}")


def with_header_rank(rows: DataFrame, names: list[str] | tuple[str, ...], column: str = "rname") -> DataFrame:
    """``header_rank``: place of the sequence in the file's header, after all others if it isn't there."""
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return rows.withColumn("header_rank", F.coalesce(F.try_element_at(ranks, F.col(column)), F.lit(len(names))))
