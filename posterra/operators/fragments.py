"""Reads and fragments: tallies, distributions, pairing, compatibility, counting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.stats import entropy
from .intervals import overlap_join

FIRST = Window.unboundedPreceding
#: Upper bounds of the fifteen GC bins.
GC_UPPERS = (0.29, 0.32, 0.35, 0.37, 0.39, 0.41, 0.43, 0.45, 0.48, 0.51, 0.53, 0.57, 0.60, 0.64, 1.00)


def mapped(alignments: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Drop unmapped reads and those on excluded sequences."""
    out = alignments.where(~C.has_flag(F.col("flag"), C.UNMAPPED) & F.col("rname").isNotNull() & (F.col("rname") != "*"))
    return out.where(~F.col("rname").isin(*exclude)) if exclude else out


def properly_paired(alignments: DataFrame) -> DataFrame:
    """Of mapped reads drop mates on different sequences and pairs that are not proper."""
    flag = F.col("flag")
    same = (F.col("rnext") == "=") | (F.col("rnext") == F.col("rname")) | (F.col("rnext") == "*")
    return alignments.where(~C.has_flag(flag, C.PAIRED) | (same & C.has_flag(flag, C.PROPER)))


def unsorted_rows(alignments: DataFrame, by: str, order: str) -> DataFrame:
    """Rows whose position is before that of the row before them (``order`` is the place in the file)."""
    w = Window.partitionBy(by).orderBy(order)
    return alignments.withColumn("__before", F.lag("pos").over(w)).where("__before > pos").drop("__before")


def position_tally(reads: DataFrame, keys: Sequence[str] = ("seqname", "strand", "pos"), interval: str = "interval_id") -> DataFrame:
    """Reads by position; of several intervals the first wins."""
    return reads.groupBy(*keys).agg(F.min(interval).alias(interval), F.count(F.lit(1)).alias("count"))


def length_histogram(fragments: DataFrame, length: str = "length", most: int = 1000) -> DataFrame:
    return fragments.where((F.col(length) > 0) & (F.col(length) <= most)).groupBy(length).agg(F.count(F.lit(1)).alias("count"))


def empirical_distribution(histogram: DataFrame, x: str, count: str = "count", tail: float = 1e-6) -> DataFrame:
    """(x, pdf, cdf), the tail beyond a cdf of ``1 - tail`` cut off and the rest renormalised.

    A histogram is bounded by the longest fragment, so one window holds it.
    """
    w = Window.orderBy(x)
    total = F.sum(count).over(Window.partitionBy())
    upto = F.sum(count).over(w.rowsBetween(FIRST, 0))
    rows = histogram.select(x, count, total.alias("total"), upto.alias("upto"))
    kept = rows.where((F.col("upto") - F.col(count)) < (1 - tail) * F.col("total"))
    whole = F.sum(count).over(Window.partitionBy())
    kept = kept.select(x, (F.col(count) / whole).alias("pdf"), (F.col("upto") / whole).alias("cdf"))
    return kept


def weighted_median(histogram: DataFrame, x: str, count: str = "count") -> DataFrame:
    """One row: the smallest x with at least half of the counts at or below it."""
    w = Window.orderBy(x).rowsBetween(FIRST, 0)
    rows = histogram.select(x, F.sum(count).over(w).alias("upto"), F.sum(count).over(Window.partitionBy()).alias("total"))
    return rows.where("2 * upto >= total").agg(F.min(x).alias("median"))


def strand_entropy(rows: DataFrame, agrees: Column) -> DataFrame:
    """One row: share of agreeing strands and its negative entropy."""
    return rows.agg(F.avg(F.when(agrees, 1.0).otherwise(0.0)).alias("specificity")).select("specificity", entropy(F.col("specificity")).alias("negentropy"))


def gc_bin(gc: Column) -> Column:
    """Index of the first bin whose upper bound is at least ``gc``."""
    out = F.lit(len(GC_UPPERS) - 1)
    for i in reversed(range(len(GC_UPPERS))):
        out = F.when(gc <= GC_UPPERS[i], i).otherwise(out)
    return out


def gc_bias(fore: DataFrame, back: DataFrame, gc: str = "gc", weight: str = "weight", most: float = 100.0) -> DataFrame:
    """(bin, fore, back, bias): ratio of the shares of each bin, within [1/most, most]; not finite is 1."""

    def share(df: DataFrame, name: str) -> DataFrame:
        bins = df.groupBy(gc_bin(F.col(gc)).alias("bin")).agg(F.sum(weight).alias("w"))
        return bins.select("bin", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias(name))

    both = share(fore, "fore").join(share(back, "back"), "bin", "full_outer").select("bin", F.coalesce("fore", F.lit(0.0)).alias("fore"), F.coalesce("back", F.lit(0.0)).alias("back"))
    ratio = F.when((F.col("back") > 0) & (F.col("fore") >= 0), F.least(F.greatest(F.try_divide("fore", "back"), F.lit(1 / most)), F.lit(most))).otherwise(F.lit(1.0))
    return both.withColumn("bias", ratio)


def unique_counts(reads: DataFrame, keys: Sequence[str], structure: Sequence[str]) -> DataFrame:
    """Distinct alignment structures with the number of reads that have them."""
    return reads.groupBy(*keys, *structure).agg(F.count(F.lit(1)).alias("count"))


def mate_counts(alignments: DataFrame) -> DataFrame:
    """(qname, mate1, mate2): alignments of either mate; single reads count as mate 1."""
    second = C.has_flag(F.col("flag"), C.READ2)
    return alignments.groupBy("qname").agg(F.count_if(~second).alias("mate1"), F.count_if(second).alias("mate2"))


def uniquely_mapped(alignments: DataFrame) -> DataFrame:
    many = mate_counts(alignments).where((F.col("mate1") > 1) | (F.col("mate2") > 1))
    return alignments.join(many.select("qname"), "qname", "left_anti")


def valid_fragment(kind: str, same_number: Column, first_reverse: Column, second_reverse: Column, first_left: Column) -> Column:
    """Whether two mates point as the library type (FR, RF, FF) says and belong to one alignment."""
    if kind == "FR":
        facing = first_reverse != second_reverse
        toward = F.when(first_left, ~first_reverse).otherwise(first_reverse)
    elif kind == "RF":
        facing = first_reverse != second_reverse
        toward = F.when(first_left, first_reverse).otherwise(~first_reverse)
    elif kind == "FF":
        facing, toward = first_reverse == second_reverse, F.lit(True)
    else:
        raise ValueError(f"unknown library type {kind}")
    return same_number & facing & toward


def mate_pairs(alignments: DataFrame, kind: str = "FR") -> DataFrame:
    """Valid pairs of mates by read and sequence; a read without a second mate is a pair of its own.

    Expects (qname, rname, flag, pos, end, alnnum, cigar); gives mate1 and mate2 structs (mate2 may be null).
    """
    mate = F.struct("pos", "end", "flag", "alnnum", "cigar")
    second = C.has_flag(F.col("flag"), C.READ2)
    one = alignments.where(~second).select("qname", "rname", mate.alias("mate1"))
    two = alignments.where(second).select("qname", "rname", mate.alias("mate2"))
    reverse = lambda m: C.has_flag(F.col(f"{m}.flag"), C.REVERSE)
    ok = valid_fragment(kind, F.col("mate1.alnnum") == F.col("mate2.alnnum"), reverse("mate1"), reverse("mate2"), F.col("mate1.pos") <= F.col("mate2.pos"))
    pairs = one.join(two, ["qname", "rname"]).where(ok)
    single = one.where(~C.has_flag(F.col("mate1.flag"), C.PAIRED)).withColumn("mate2", F.lit(None).cast(pairs.schema["mate2"].dataType))
    return pairs.unionByName(single)


def strand_matches(mode: str, fragment_strand: Column, transcript_strand: Column) -> Column:
    """none: any; forward: equal; reverse: opposite."""
    if mode == "none":
        return F.lit(True)
    if mode in ("forward", "reverse"):
        same = fragment_strand == transcript_strand
        return same if mode == "forward" else ~same
    raise ValueError(f"unknown strandedness {mode}")


def fragment_strand(first_reverse: Column, is_second: Column) -> Column:
    """Strand of the fragment's first mate."""
    return F.when(first_reverse != is_second, F.lit("-")).otherwise(F.lit("+"))


def naive_length(mate1: str = "mate1", mate2: str = "mate2") -> Column:
    """Outer span of both mates; 0 for a single read or a span shorter than a mate."""
    lo, hi = F.least(f"{mate1}.pos", f"{mate2}.pos"), F.greatest(f"{mate1}.end", f"{mate2}.end")
    span = hi - lo + 1
    longest = F.greatest(F.col(f"{mate1}.end") - F.col(f"{mate1}.pos"), F.col(f"{mate2}.end") - F.col(f"{mate2}.pos")) + 1
    return F.when(F.col(mate2).isNull() | (span < longest), 0).otherwise(span)


def compatible_length(blocks: Column, exons: Column, overhang: int = 2) -> Column:
    """How a read's aligned blocks (closed, ascending) fit a transcript's exons: bases covered, or -1.

    Every block must lie in one exon, up to ``overhang`` bases beyond its ends; every gap
    between blocks must be an intron exactly (within the overhang); a transcript's intron
    must not lie inside a block.
    """
    near = lambda a, b: F.abs(a - b) <= overhang
    inside = F.forall(blocks, lambda b: F.exists(exons, lambda e: (b["start"] >= e["start"] - overhang) & (b["end"] <= e["end"] + overhang)))
    gaps = F.zip_with(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("l"), b["start"].alias("r")))
    introns = F.zip_with(F.slice(exons, 1, F.greatest(F.size(exons) - 1, F.lit(0))), F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("l"), b["start"].alias("r")))
    spliced = F.forall(gaps, lambda g: F.exists(introns, lambda i: near(g["l"], i["l"]) & near(g["r"], i["r"])))
    covered = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + b["end"] - b["start"] + 1)
    return F.when(inside & spliced, covered).otherwise(F.lit(-1).cast("long"))


def fragment_length_in(transcript_exons: Column, lo: Column, hi: Column) -> Column:
    """Bases of the transcript between two of its genomic positions, both included."""
    piece = lambda e: F.greatest(F.lit(0), F.least(e["end"], hi) - F.greatest(e["start"], lo) + 1)
    return F.aggregate(transcript_exons, F.lit(0).cast("long"), lambda acc, e: acc + piece(e))


def compatibility(fragments: DataFrame, transcripts: DataFrame, strandedness: str = "none", bin_width: int = 16384) -> DataFrame:
    """(fragment columns, tid, gene_id, frag_len) of compatible pairs; frag_len 0 for single reads.

    fragments: (frag, seqname, strand, start, end, blocks1, blocks2); transcripts: (tid, gene_id,
    seqname, t_strand, min_start, max_end, exons).
    """
    pairs = overlap_join(fragments, transcripts, ["seqname"], ("start", "end"), ("min_start", "max_end"), bin_width)
    pairs = pairs.where(strand_matches(strandedness, F.col("strand"), F.col("t_strand")))
    fits = (compatible_length(F.col("blocks1"), F.col("exons")) >= 0) & (F.col("blocks2").isNull() | (compatible_length(F.col("blocks2"), F.col("exons")) >= 0))
    length = F.when(F.col("blocks2").isNull(), F.lit(0).cast("long")).otherwise(fragment_length_in(F.col("exons"), F.col("start"), F.col("end")))
    return pairs.where(fits).withColumn("frag_len", length)


def gene_counts(pairs: DataFrame, genes: DataFrame, fragment: str = "frag", gene: str = "gene_id") -> DataFrame:
    """Fragments that fit transcripts of exactly one gene, by gene; genes without any count 0."""
    one = pairs.groupBy(fragment).agg(F.min(gene).alias(gene), F.max(gene).alias("__other")).where(F.col(gene) == F.col("__other"))
    counts = one.groupBy(gene).agg(F.count(F.lit(1)).alias("count"))
    return genes.select(gene).distinct().join(counts, gene, "left").select(gene, F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def best_alignment(weights: DataFrame, keys: Sequence[str] = ("tid", "read"), order: str = "seq") -> DataFrame:
    """Of each (transcript, read) the alignment with the largest align_pr * w; the first of equals."""
    best = F.max_by(F.struct("w", "align_pr", order), F.struct(F.col("w") * F.col("align_pr"), -F.col(order)))
    return weights.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def alignment_sums(alignments: DataFrame, read: str = "read", locus: str = "locus") -> DataFrame:
    """Per read the sum over loci of the largest alignment probability in each."""
    return alignments.groupBy(read, locus).agg(F.max("align_pr").alias("p")).groupBy(read).agg(F.sum("p").alias("align_sum"))


def prune(alignments: DataFrame, read: str = "read", least: float = 0.1) -> DataFrame:
    """Share of each alignment in its read's probability; shares under ``least`` are dropped."""
    share = F.col("align_pr") / F.sum("align_pr").over(Window.partitionBy(read))
    return alignments.withColumn("share", share).where(F.col("share") >= least)


_LETTER = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate(("aA", "cC", "gG", "tT")):
    _LETTER[[ord(c) for c in _c]] = _i


def _count_kmers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(4**k, dtype=np.int64)
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        if not len(column) or data is None:
            continue
        offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        # a long batch is taken in pieces of whole texts
        at = 0
        while at < len(column):
            last = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 22), side="right")) - 1)
            code = _LETTER[np.frombuffer(data, dtype=np.uint8)[offs[at] : offs[last]]]
            text = np.repeat(np.arange(last - at), np.diff(offs[at : last + 1]))[code < 4]
            code = code[code < 4].astype(np.int64)
            n = len(code) - k + 1
            if n > 0:
                number = np.zeros(n, dtype=np.int64)
                for j in range(k):
                    number = number * 4 + code[j : j + n]
                totals += np.bincount(number[text[:n] == text[k - 1 :]], minlength=4**k)
            at = last
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["number", "count"])


def kmer_totals(texts: DataFrame, column: str, k: int) -> DataFrame:
    """(number, count) of the k-mers of each text's letters A, C, G and T, others left out; a task sends at most ``4 ** k`` rows."""
    rows = texts.where(F.col(column).isNotNull()).select(F.col(column).cast("string"))
    return rows.mapInArrow(lambda it: _count_kmers(it, k), "number long, count long").groupBy("number").agg(F.sum("count").alias("count"))


def kmer_distribution(kmers: DataFrame, position: str = "pos", kmer: str = "kmer") -> DataFrame:
    """(position, kmer, count, p)."""
    counts = kmers.groupBy(position, kmer).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy(position)))


def symmetric_divergence(fore: DataFrame, back: DataFrame, position: str = "pos", kmer: str = "kmer") -> DataFrame:
    """(position, divergence): KL both ways in bits over k-mers that both have."""
    both = fore.select(position, kmer, F.col("p")).join(back.select(position, kmer, F.col("p").alias("q")), [position, kmer])
    gap = F.log2("p") - F.log2("q")
    return both.groupBy(position).agg((F.sum(F.col("p") * gap) - F.sum(F.col("q") * gap)).alias("divergence"))


def rolling_gc(bases: DataFrame, width: int, by: Sequence[str] = ("tid",), order: str = "pos", is_gc: str = "gc") -> DataFrame:
    """GC bases in the window of ``width`` that ends at each position."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
    return bases.withColumn("gc_count", F.sum(is_gc).over(w))


def three_prime_distance(exons: DataFrame, by: Sequence[str] = ("tid",)) -> DataFrame:
    """Transcript bases between each exon and the transcript's 3' end."""
    length = F.col("end") - F.col("start") + 1
    after = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(FIRST, -1)
    distance = F.when(F.col("strand") == "-", F.sum(length).over(before)).otherwise(F.sum(length).over(after))
    return exons.withColumn("distance", F.coalesce(distance, F.lit(0)))


def capped(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of a seeded order that depends on the rows, not on their partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
