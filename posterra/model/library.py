"""The bias models of one sequenced library, and what they say of transcripts and fragments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import fragments, intervals, prefix
from ..session import checkpointed
from ..sources import fasta
from . import bias, weights
from .bias import LEFT, RIGHT, LengthModel, Motif

#: Fixed value: least length of an interval whose GC content trains.
LEAST_GC_INTERVAL = 500
#: Fixed value: positions at which the sequence bias of libraries is compared, the first in order.
COMPARED_POSITIONS = 100_000


@dataclass
class Library:
    """What was trained; a model that is None or 0 changes nothing."""

    lengths: LengthModel
    specificity: float = 0.5
    three_prime: float = 0.0
    fragmentation: bool = False
    gc: np.ndarray | None = None
    motifs: tuple[Motif, Motif] | None = None

    @property
    def reads_sequence(self) -> bool:
        return self.gc is not None or self.motifs is not None


def with_sequences(transcripts: DataFrame, genome: DataFrame) -> DataFrame:
    """``transcripts`` (seqname, strand, exons) with their spliced ``sequence``, 5' to 3', padded by what a motif sees; without their sequence they are all N.

    ``genome`` has tiles (seqname, tile, first, seq) or sequences (seqname, seq). Each exon fetches its bases from
    the tiles that it touches, the outer ones with what a motif sees.
    """
    flank = max(LEFT, RIGHT)
    outer = lambda i, at: F.when(i == at, flank).otherwise(0)
    padded = F.transform("exons", lambda e, i: F.struct((e["start"] - outer(i, F.lit(0))).alias("start"), (e["end"] + outer(i, F.size("exons") - 1)).alias("end")))
    exon = transcripts.select("tid", "seqname", F.posexplode(padded).alias("k", "e")).select(F.struct("tid", "k").alias("id"), "seqname", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))
    found = fasta.fetch(exon, bias.tiles(genome, 0 if "tile" in genome.columns else flank))
    forward = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id.k").alias("k"), "seq"))), lambda x: x["seq"]), "")
    made = found.groupBy(F.col("id.tid").alias("tid")).agg(forward.alias("forward"))
    rows = transcripts.join(made, "tid", "left")
    sequence = F.when(F.col("strand") == "-", S.reverse_complement(F.col("forward"))).otherwise(F.col("forward"))
    return rows.withColumn("sequence", F.coalesce(sequence, F.lit(""))).drop("forward")


def placed(pairs: DataFrame) -> DataFrame:
    """``pairs`` (start, end, exons, min_start, max_end, t_strand) with ``five``: bases of the transcript before the fragment's 5' end."""
    before = fragments.fragment_length_in(F.col("exons"), F.col("min_start"), F.col("start") - 1)
    after = fragments.fragment_length_in(F.col("exons"), F.col("end") + 1, F.col("max_end"))
    return pairs.withColumn("five", F.when(F.col("t_strand") == "-", after).otherwise(before))


def train(pairs: DataFrame, transcripts: DataFrame, stranded: bool, genome: DataFrame | None = None, fragmentation: bool = False, sequences: DataFrame | None = None, seed: int = 0) -> Library:
    """Models of a library from its compatible ``pairs`` (frag, seqname, strand, start, end, tid, t_strand, frag_len, five, plain, ...).

    With ``genome`` sequence and GC bias are learned too; ``sequences`` (seqname) names those to learn from, none: all.
    """
    used = pairs if sequences is None else pairs.join(sequences.select("seqname").distinct(), "seqname", "left_semi")
    # one pass over the pairs; a fragment has one place and strand
    agrees = (F.col("strand") == F.col("t_strand")).cast("int")
    measured = F.when((F.col("frag_len") > 0) & F.col("plain"), F.col("frag_len"))
    frags = checkpointed(
        used.groupBy("frag").agg(
            F.min(measured).alias("length"), F.sum(agrees).alias("agree"), F.count("t_strand").alias("n"), F.min("tid").alias("tid"), F.max("tid").alias("other"), F.min("five").alias("five"),
            *[F.min(c).alias(c) for c in ("seqname", "strand", "start", "end")],
        )
    )
    lengths = LengthModel.fit(fragments.length_histogram(frags.where("length is not null")))
    specificity = (frags.agg(F.sum("agree") / F.sum("n")).first()[0] or 0.5) if stranded else 0.5
    # fragments of one transcript only tell where in it they lie
    long = transcripts.where(F.col("exonic_length").between(*bias.THREE_PRIME_LENGTHS)).select("tid", "exonic_length")
    long = prefix.until(long, ["tid"], F.lit(1), bias.THREE_PRIME_TRANSCRIPTS)
    distances = frags.where("tid = other").join(long, "tid").select((F.col("exonic_length") - 1 - F.col("five")).alias("tpdist"), F.col("exonic_length").alias("tlen"))
    library = Library(lengths, specificity, bias.three_prime_rate(distances.where("tpdist >= 0"), *bias.THREE_PRIME_RANGE), fragmentation)
    if genome is not None:
        first, last = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")), F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("end"))
        tally = lambda strand, pos: frags.groupBy("seqname", strand.alias("strand"), pos.alias("pos")).agg(F.count(F.lit(1)).alias("count"))
        counted = checkpointed(tally(F.col("strand"), first))
        opposite = tally(F.when(F.col("strand") == "-", "+").otherwise("-"), last)
        library.motifs = tuple(bias.train_motif(bias.windows(rows, genome, seed)) for rows in (counted, opposite))
        exon = transcripts.select("seqname", F.explode("exons").alias("e")).select("seqname", F.col("e.start").alias("x_start"), F.col("e.end").alias("x_end")).where(F.col("x_end") - F.col("x_start") + 1 >= LEAST_GC_INTERVAL).distinct()
        inside = fragments.overlap_join(counted.withColumn("at", F.col("pos")), exon, ["seqname"], ("pos", "at"), ("x_start", "x_end"), 16384, contained=True)
        rows = bias.gc_windows(inside.withColumnsRenamed({"x_start": "start", "x_end": "end"}), genome, lengths.median)
        ratios = {r["bin"]: r["bias"] for r in fragments.gc_bias(rows.where("fore = 1"), rows.where("fore = 0")).collect()}
        library.gc = np.array([ratios.get(i, 1.0) for i in range(len(fragments.GC_UPPERS))])
    return library


def _differences(batches, motifs: list[tuple[Motif, Motif]]):
    """(a, b, total, n) of a task: sums of absolute log2 ratios of every two libraries' bias, over both ends of the windows without an N."""
    totals, seen = np.zeros((len(motifs), len(motifs))), 0
    for batch in batches:
        text = [s for s in batch.column(0).to_pylist() if s is not None and len(s) == LEFT + 1 + RIGHT and not s.strip("ACGT")]
        seen += len(text)
        if text:
            codes = bias.encode(text)
            for end in range(2):
                logs = np.stack([pair[end].log_ratio(codes) for pair in motifs]) / np.log(2)
                for a in range(len(motifs)):
                    totals[a] += np.abs(logs - logs[a]).sum(axis=1)
    a, b = np.triu_indices(len(motifs), 1)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(totals[a, b]), pa.array(np.full(len(a), seen))], names=["a", "b", "total", "n"])


def motif_differences(exons: DataFrame, genome: DataFrame, libraries: dict[int, Library], most: int = COMPARED_POSITIONS) -> list[tuple[int, int, float]]:
    """(sample, other, difference) of every two libraries: the mean over exonic positions of the absolute log2 ratio of their bias, both ends added up.

    Exonic stretches are taken in natural order up to the one that brings them to ``most`` positions. What reaches the driver is a row a pair.
    """
    numbers = [n for n, one in sorted(libraries.items()) if one.motifs is not None]
    if len(numbers) < 2:
        return []
    motifs = [libraries[n].motifs for n in numbers]
    stretches = prefix.until(intervals.union(exons.select("seqname", "start", "end"), ["seqname"]), [S.natural_number(F.col("seqname")), "seqname", "start"], F.col("end") - F.col("start") + 1, most)
    places = stretches.select("seqname", F.explode(F.sequence("start", "end")).alias("at"))
    rows = bias.with_tiles(places, genome, "at", LEFT + RIGHT + 1)
    window = F.substring("seq", (F.col("at") - F.col("first") - LEFT + 1).cast("int"), F.lit(LEFT + 1 + RIGHT))
    parts = rows.where(F.col("at") - F.col("first") >= LEFT).select(window.alias("s")).mapInArrow(lambda it: _differences(it, motifs), "a int, b int, total double, n long")
    found = parts.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("a", "b").collect()
    return [(numbers[r["a"]], numbers[r["b"]], r["total"] / r["n"] if r["n"] else 0.0) for r in found]


def effective_lengths(transcripts: DataFrame, library: Library) -> DataFrame:
    """(tid, weight) under all models; ``transcripts`` has ``sequence`` where the library reads it."""
    return weights.transcript_weights(transcripts, library.lengths, library.three_prime, library.fragmentation, library.gc, library.motifs)


def _scored(batches, library: Library):
    places: dict[int, np.ndarray] = {}
    for batch in batches:
        n, five, size = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("exonic_length", "five", "size"))
        out = np.ones(len(n))
        for i, (length, at) in enumerate(zip(n.tolist(), five.tolist(), strict=True)):
            if length not in places:
                if len(places) > 10_000:
                    places.clear()
                places[length] = weights.place_factor(length, library.lengths, library.three_prime, library.fragmentation)
            out[i] = places[length][at] if 0 <= at < length else 0.0
        if library.gc is not None:
            count = batch.column(batch.schema.get_field_index("gc_count")).to_numpy(zero_copy_only=False)
            out *= bias.gc_factor(count / np.maximum(size, 1), library.gc)
        if library.motifs is not None:
            for name, motif in zip(("head", "tail"), library.motifs, strict=True):
                text = batch.column(batch.schema.get_field_index(name)).to_pylist()
                known = np.array([s is not None and len(s) == LEFT + 1 + RIGHT and not s.strip("ACGT") for s in text], dtype=bool)
                if known.any():
                    out[known] *= motif.bias(bias.encode([s for s, ok in zip(text, known, strict=True) if ok]))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("frag", "tid")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out)], names=["frag", "tid", "bias"])


def fragment_bias(pairs: DataFrame, transcripts: DataFrame, library: Library) -> DataFrame:
    """(frag, tid, bias) of compatible pairs: place, GC content and the surroundings of both ends."""
    rows = pairs.select("frag", "tid", "five", F.when(F.col("frag_len") > 0, F.col("frag_len")).otherwise(F.lit(library.lengths.median)).alias("size"))
    names = ["tid", "exonic_length", *(["sequence"] if library.reads_sequence else [])]
    rows = rows.join(transcripts.select(*names), "tid")
    more = []
    if library.reads_sequence:
        at = lambda shift: (F.col("five") + LEFT + 1 + shift).cast("int")
        last = F.least(F.col("five") + F.col("size"), F.col("exonic_length")) - 1
        whole = F.substring("sequence", at(0), (last - F.col("five") + 1).cast("int"))
        tail = F.substring("sequence", (last + LEFT + 1 - RIGHT).cast("int"), F.lit(LEFT + 1 + RIGHT))
        more = [S.gc_count(whole).alias("gc_count"), F.upper(F.substring("sequence", at(-LEFT), F.lit(LEFT + 1 + RIGHT))).alias("head"), F.upper(S.reverse_complement(tail)).alias("tail")]
    rows = rows.select("frag", "tid", "five", "size", "exonic_length", *more)
    return rows.mapInArrow(lambda it: _scored(it, library), "frag string, tid int, bias double")
