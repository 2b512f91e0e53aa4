"""Effective lengths of transcripts and probabilities of fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fragments import prune
from .bias import LEFT, RIGHT, LengthModel, Motif, encode, fragmentation_profile, gc_factor, three_prime_factor

#: A fragment length of less probability is impossible for a fragment; one of less than the second
#: makes bias immaterial for an effective length; least weight of a fragment; least effective length.
LEAST_LENGTH_PR = 1e-5
LEAST_BIASED_LENGTH_PR = 1e-3
LEAST_FRAGMENT_WEIGHT = 1e-6
LEAST_TRANSCRIPT_WEIGHT = 25.0


def place_factor(n: int, lengths: LengthModel, three_prime: float, fragmentation: bool) -> np.ndarray:
    """Factor of a fragment by the place of its 5' end in a transcript of ``n`` bases: 3' bias and fragmentation."""
    out = three_prime_factor(three_prime, np.arange(n, 0, -1))
    if fragmentation:
        out = out * fragmentation_profile(n, lengths)
    return np.where(np.isfinite(out), out, 0.0)


def effective_length(n: int, lengths: LengthModel, place: np.ndarray, sense: np.ndarray | None = None, antisense: np.ndarray | None = None, gc: np.ndarray | None = None, is_gc: np.ndarray | None = None) -> float:
    """Sum over fragment lengths of P(length) times the bias-weighted starts that leave room for it, all from 5' to 3'."""
    sizes = np.arange(1, min(n, len(lengths.pdf) - 1) + 1)
    p = lengths.pdf[sizes]
    biased = p >= LEAST_BIASED_LENGTH_PR
    total = float((p[~biased] * (n - sizes[~biased] + 1)).sum())
    if sense is None and gc is None:
        upto = np.concatenate(([0.0], np.cumsum(place)))
        total += float((p[biased] * upto[n - sizes[biased] + 1]).sum())
    else:
        start = place if sense is None else place * sense
        counts = None if gc is None else np.concatenate(([0], np.cumsum(is_gc)))
        for size, pr in zip(sizes[biased], p[biased], strict=True):
            w = start[: n - size + 1]
            if antisense is not None:
                w = w * antisense[size - 1 :]
            if gc is not None:
                w = w * gc_factor((counts[size:] - counts[:-size]) / size, gc)
            total += float(pr * w.sum())
    return max(LEAST_TRANSCRIPT_WEIGHT, total) if np.isfinite(total) else LEAST_TRANSCRIPT_WEIGHT


def transcript_weights(transcripts: DataFrame, lengths: LengthModel, three_prime: float = 0.0, fragmentation: bool = False, gc: np.ndarray | None = None, motifs: tuple[Motif, Motif] | None = None) -> DataFrame:
    """(tid, weight): effective lengths of (tid, exonic_length), and ``sequence`` (5' to 3', padded as motifs need) with ``gc`` or ``motifs``."""
    by_sequence = gc is not None or motifs is not None

    def run(batches):
        for batch in batches:
            sizes = batch["exonic_length"].to_numpy().astype(int)
            places = {n: place_factor(n, lengths, three_prime, fragmentation) for n in set(sizes.tolist())}
            if by_sequence:
                out = []
                for n, s in zip(sizes.tolist(), batch["sequence"], strict=True):
                    codes = encode([s])[0]
                    inner = codes[LEFT : LEFT + n]
                    sense = antisense = None
                    if motifs is not None:
                        sense, antisense = motif_along(motifs, codes, n)
                    out.append(effective_length(n, lengths, places[n], sense, antisense, gc, (inner == 1) | (inner == 2)))
            else:
                known = {n: effective_length(n, lengths, place) for n, place in places.items()}
                out = [known[n] for n in sizes.tolist()]
            yield pd.DataFrame({"tid": batch["tid"], "weight": out})

    return transcripts.select("tid", "exonic_length", *(["sequence"] if by_sequence else [])).mapInPandas(run, "tid int, weight double")


def motif_along(motifs: tuple[Motif, Motif], codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias of a fragment that starts, and of one that ends, at each base of a padded transcript; 1 where a letter is unknown."""
    windows = np.lib.stride_tricks.sliding_window_view(codes, LEFT + 1 + RIGHT)[:n]
    out = []
    for motif, w in ((motifs[0], windows), (motifs[1], np.where(windows >= 0, 3 - windows, -1)[:, ::-1])):
        known = (w >= 0).all(axis=1)
        bias = np.ones(n)
        bias[known] = motif.bias(w[known])
        out.append(bias)
    return out[0], out[1]


def fragment_weights(pairs: DataFrame, weights: DataFrame, lengths: LengthModel, specificity: float = 0.5) -> DataFrame:
    """(frag, tid, w): probability of a compatible fragment given its transcript.

    pairs: (frag, tid, frag_len, agrees, bias). Lengths become a lookup of at most a thousand entries.
    What is too improbable goes before the effective length is divided out.
    """
    pdf = F.array(*[F.lit(float(p)) for p in lengths.pdf])
    size = F.when(F.col("frag_len") > 0, F.col("frag_len")).otherwise(F.lit(lengths.median))
    p = F.coalesce(F.get(pdf, size.cast("int")), F.lit(0.0))
    strand = F.when(F.col("agrees"), specificity).otherwise(1 - specificity)
    rows = pairs.select("frag", "tid", (F.when(p < LEAST_LENGTH_PR, 0.0).otherwise(p) * strand * F.col("bias")).alias("w")).where(F.col("w") >= LEAST_FRAGMENT_WEIGHT)
    return rows.join(weights, "tid").select("frag", "tid", (F.col("w") / F.col("weight")).alias("w"))


def weight_matrix(alignments: DataFrame, least: float = 0.1) -> DataFrame:
    """(tid, frag, w): best alignment of each fragment on each transcript, improbable ones dropped.

    alignments: (frag, tid, locus, align_pr, w).
    """
    best = alignments.groupBy("frag", "locus").agg(F.max("align_pr").alias("align_pr"))
    kept = prune(best, "frag", least).select("frag", "locus", "share")
    rows = alignments.join(kept, ["frag", "locus"])
    return rows.groupBy("tid", "frag").agg(F.max(F.col("w") * F.col("share")).alias("w")).where("w > 0")


def expression(mixtures: DataFrame) -> DataFrame:
    """(sample, tid, value) of (sample, tid, tmix, cmix, weight): normalised tmix * cmix / weight."""
    raw = F.col("tmix") * F.col("cmix") / F.col("weight")
    rows = mixtures.withColumn("value", raw)
    return rows.select("sample", "tid", (F.col("value") / F.sum("value").over(Window.partitionBy("sample"))).alias("value"))
