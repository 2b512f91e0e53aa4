"""Bias models of sequencing: sequence motif, GC, 3' end, fragmentation, fragment length, strand."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators.fragments import GC_UPPERS, capped
from ..sources import fasta
from .slice import maximum

#: Bases to either side of a read's start, reads that train a motif, parents of a place and their distance.
LEFT, RIGHT = 15, 15
MOST_READS = 50_000
MOST_PARENTS, MOST_DISTANCE = 4, 10
COMPLEXITY = 1.0
#: Lengths of transcripts that train a library's 3' rate, and the range of its logarithm.
THREE_PRIME_LENGTHS = (5000, 10000)
#: Fixed value: transcripts that train it at most, the first in order.
THREE_PRIME_TRANSCRIPTS = 200_000
THREE_PRIME_RANGE = (-100.0, -10.0)


# --- fragment length ----------------------------------------------------------------------------


@dataclass
class LengthModel:
    """pdf and cdf by length; with too few pairs a normal distribution."""

    pdf: np.ndarray
    median: int

    @property
    def cdf(self) -> np.ndarray:
        return np.cumsum(self.pdf)

    @staticmethod
    def fit(histogram: DataFrame, least: int = 10_000, mu: float = 200.0, sd: float = 100.0, most: int = 1000) -> LengthModel:
        """histogram: (length, count), at most ``most`` rows."""
        counts = np.zeros(most + 1)
        for row in histogram.where((F.col("length") > 0) & (F.col("length") <= most)).select("length", "count").collect():
            counts[row["length"]] = row["count"]
        if counts.sum() < least:
            x = np.arange(most + 1)
            counts = np.exp(-0.5 * ((x - mu) / sd) ** 2)
            counts[0] = 0
        pdf = counts / counts.sum()
        return LengthModel(pdf, int(np.searchsorted(np.cumsum(pdf), 0.5)))


# --- sequence motif -----------------------------------------------------------------------------


def windows(positions: DataFrame, sequences: DataFrame, seed: int, most: int = MOST_READS, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """(fore, s): read starts with their surroundings, each with a background at a seeded offset of up to ten bases either way.

    positions: (seqname, strand, pos, count). The cap is the model's sample size and is drawn by hash.
    """
    chosen = capped(positions, most, seed, "seqname", "strand", "pos")
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "seqname", "strand", "pos"), F.lit(21)).cast("long") - 10
    reach = left + right + 12
    rows = with_tiles(chosen.withColumn("other", F.col("pos") + offset), sequences, "pos", reach)

    def window(at: str):
        plus = S.padded_substring(F.col("seq"), (F.col(at) - F.col("first") - left).cast("int"), F.lit(left + 1 + right))
        minus = S.reverse_complement(S.padded_substring(F.col("seq"), (F.col(at) - F.col("first") - right).cast("int"), F.lit(left + 1 + right)))
        return F.when(F.col("strand") == "-", minus).otherwise(plus)

    both = rows.select(window("pos").alias("fore"), window("other").alias("back"))
    return both.select(F.inline(F.array(F.struct(F.lit(1).alias("fore"), F.col("fore").alias("s")), F.struct(F.lit(0).alias("fore"), F.col("back").alias("s"))))).where(~F.col("s").contains("N"))


def tiles(sequences: DataFrame, reach: int, size: int = fasta.TILE) -> DataFrame:
    """(seqname, tile, first, seq) of sequences (seqname, seq), or of tiles as they were read; these reach far enough or are refused."""
    if "tile" not in sequences.columns:
        return fasta.tiles_of(sequences, size, reach)
    if reach > fasta.REACH or size != fasta.TILE:
        raise ValueError(f"tiles of {fasta.TILE} bases that reach {fasta.REACH} further are too small for {reach}")
    return sequences


def with_tiles(rows: DataFrame, sequences: DataFrame, at: str, reach: int, size: int = fasta.TILE) -> DataFrame:
    """Rows with the piece of sequence around them, so that none carries a chromosome; a place off its sequence finds none."""
    return rows.withColumn("tile", F.floor(F.col(at) / size).cast("int")).join(tiles(sequences, reach, size), ["seqname", "tile"])


_CODE = np.full(256, -1)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _i


@dataclass
class Motif:
    """A directed graph over window positions with a conditional table for either class."""

    parents: dict[int, tuple[int, ...]]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    width: int

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        """log P(window | foreground) - log P(window | background)."""
        out = np.zeros(len(codes))
        for position, parents in self.parents.items():
            row = _row(codes, parents)
            fore, back = self.tables[position]
            out += fore[row, codes[:, position]] - back[row, codes[:, position]]
        return out

    def bias(self, codes: np.ndarray) -> np.ndarray:
        return np.exp(self.log_ratio(codes))


def encode(strings: list[str]) -> np.ndarray:
    return np.array([_CODE[np.frombuffer(s.encode(), dtype=np.uint8)] for s in strings], dtype=np.int64)


def _row(codes: np.ndarray, parents: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for p in parents:
        out = out * 4 + codes[:, p]
    return out


def _table(codes: np.ndarray, position: int, parents: tuple[int, ...]) -> np.ndarray:
    counts = np.bincount(_row(codes, parents) * 4 + codes[:, position], minlength=4 ** (len(parents) + 1)).reshape(-1, 4) + 1.0
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _gain(codes: np.ndarray, fore: np.ndarray, position: int, parents: tuple[int, ...], complexity: float) -> float:
    """Class log likelihood that the position adds, less the information criterion's price."""
    row = _row(codes, parents)
    a, b = (_table(codes[fore == c], position, parents) for c in (1, 0))
    ratio = a[row, codes[:, position]] - b[row, codes[:, position]]
    sign = np.where(fore == 1, 1.0, -1.0)
    likelihood = -np.logaddexp(0, -sign * ratio).sum() + len(codes) * np.log(2)
    return likelihood - complexity * 3 * 4 ** len(parents) * np.log(len(codes))


def _acyclic(parents: dict[int, tuple[int, ...]], position: int, new: int) -> bool:
    todo, seen = [new], set()
    while todo:
        at = todo.pop()
        if at == position:
            return False
        if at not in seen:
            seen.add(at)
            todo += parents.get(at, ())
    return True


def learn_motif(codes: np.ndarray, fore: np.ndarray, complexity: float = COMPLEXITY, most_parents: int = MOST_PARENTS, distance: int = MOST_DISTANCE) -> Motif:
    """Greedy structure search: add, remove or reverse the node or edge with the best gain until none has any.

    The windows are a bounded sample (``MOST_READS`` twice), so this runs on the driver.
    """
    width = codes.shape[1]
    parents: dict[int, tuple[int, ...]] = {}
    gain: dict[tuple[int, tuple[int, ...]], float] = {}

    def of(position: int, p: tuple[int, ...]) -> float:
        if (position, p) not in gain:
            gain[position, p] = _gain(codes, fore, position, p, complexity)
        return gain[position, p]

    def worth(node: int) -> float:
        return of(node, parents[node]) if node in parents else 0.0

    while True:
        best, move = 1e-9, None
        for i in range(width):
            if i not in parents:
                if (g := of(i, ())) > best:
                    best, move = g, {i: ()}
                continue
            for j in parents:
                if j == i or abs(i - j) > distance:
                    continue
                if j in parents[i]:
                    without = tuple(p for p in parents[i] if p != j)
                    if (g := of(i, without) - worth(i)) > best:
                        best, move = g, {i: without}
                    if len(parents[j]) < most_parents and _acyclic({**parents, i: without}, j, i):
                        turned = tuple(sorted((*parents[j], i)))
                        if (g := of(i, without) - worth(i) + of(j, turned) - worth(j)) > best:
                            best, move = g, {i: without, j: turned}
                elif len(parents[i]) < most_parents and _acyclic(parents, i, j):
                    more = tuple(sorted((*parents[i], j)))
                    if (g := of(i, more) - worth(i)) > best:
                        best, move = g, {i: more}
        if move is None:
            break
        parents |= move
    tables = {i: (_table(codes[fore == 1], i, p), _table(codes[fore == 0], i, p)) for i, p in parents.items()}
    return Motif(parents, tables, width)


def train_motif(rows: DataFrame) -> Motif:
    got = rows.select("fore", "s").collect()
    if len(got) < 1000:
        return Motif({}, {}, LEFT + 1 + RIGHT)
    return learn_motif(encode([r.s for r in got]), np.array([r.fore for r in got]))


# --- GC, 3' end, fragmentation ------------------------------------------------------------------


def gc_windows(reads: DataFrame, sequences: DataFrame, length: int, most_count: int = 4) -> DataFrame:
    """(fore, gc, weight): GC share of the fragment at each read position, and of all others in the interval.

    reads: (seqname, strand, pos, count, start, end); positions read more than ``most_count`` times are left out.
    """
    inside = reads.where((F.col("count") <= most_count) & (F.col("pos") + length - 1 <= F.col("end")) & (F.col("pos") >= F.col("start")))
    other = F.col("start") + F.pmod(F.xxhash64("seqname", "strand", "pos"), F.greatest(F.col("end") - F.col("start") - length + 2, F.lit(1)))
    both = inside.select("seqname", F.inline(F.array(*[F.struct(F.lit(fore).alias("fore"), at.cast("long").alias("at"), w.cast("double").alias("weight")) for fore, at, w in ((1, F.col("pos"), F.col("count")), (0, other, F.lit(1)))])))
    rows = with_tiles(both, sequences, "at", length)
    piece = F.substring("seq", (F.col("at") - F.col("first") + 1).cast("int"), F.lit(length))
    return rows.select("fore", (S.gc_count(piece) / F.lit(length)).alias("gc"), "weight")


def gc_factor(gc: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return bias[np.minimum(np.searchsorted(np.array(GC_UPPERS), gc), len(GC_UPPERS) - 1)]


def three_prime_sums(distances: DataFrame) -> DataFrame:
    """(tlen, n, total) of (tpdist, tlen) pairs: how many, and the sum of their distances; a row a length, of which a range of lengths bounds the number."""
    return distances.groupBy("tlen").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tpdist").cast("long")).alias("total"))


def three_prime_likelihood(distances: DataFrame, rates: DataFrame) -> DataFrame:
    """(rate, likelihood): log likelihood of the truncated geometric of (tpdist, tlen) pairs at each of a list of rates."""
    each = rates.crossJoin(F.broadcast(three_prime_sums(distances)))
    terms = F.col("n") * F.log("rate") + F.col("total") * F.log(1 - F.col("rate")) - F.col("n") * F.log(1 - F.pow(1 - F.col("rate"), F.col("tlen")))
    return each.groupBy("rate").agg(F.sum(terms).alias("likelihood"))


def three_prime_rate(distances: DataFrame, low: float = -100.0, high: float = -1e-3) -> float:
    """p of the truncated geometric of (tpdist, tlen) pairs: the share of fragments lost at each base; its logarithm is looked for from ``low`` to ``high``.

    The likelihood depends on sums by length alone, which are all that reaches the driver.
    """
    counts = three_prime_sums(distances).collect()
    if not counts:
        return 0.0
    t, n, total = (np.array([r[i] for r in counts], dtype=float) for i in range(3))

    def likelihood(log_p: np.ndarray) -> np.ndarray:
        p = np.exp(np.asarray(log_p))[:, None]
        keep = np.log1p(-p)
        return (n * (np.log(p) - np.log(-np.expm1(t * keep) + 1e-300)) + total * keep).sum(axis=1)

    return float(np.exp(maximum(likelihood, 1, low, high)[0]))


def three_prime_factor(p: float, distance: np.ndarray) -> np.ndarray:
    return np.exp(np.log1p(-p) * distance)


#: Share of unbroken runs that is neglected, and the scale of the profile.
LEAST_RUN, FRAGMENTATION_SCALE = 1e-5, 3e5


def fragmentation_profile(n: int, lengths: LengthModel) -> np.ndarray:
    """Chance that a fragment of a transcript of ``n`` bases starts at each base, over the chance that its length has room there.

    Transcripts break at each base with half the inverse of the median fragment length. What holds
    the start u is the whole transcript, a piece of its left end, a piece of its right end, or
    a piece between two breaks; a fragment is then as likely to start at any base of the piece, and is
    selected with the share of lengths that fit. Exact at every length; sums over pieces are
    correlations, cut where unbroken runs become improbable.
    """
    p = 0.5 / max(1, lengths.median)
    keep = 1 - p
    most = max(1, round(np.log(LEAST_RUN) / np.log(keep)))
    m = np.arange(1, most)
    unbroken = np.concatenate(([1.0], keep ** (m - 1)))
    summed = np.concatenate(([1.0], 1.0 + np.cumsum(keep ** (m - 1) / m)))
    run = lambda k: np.where(k < most, unbroken[np.minimum(k, most - 1)], 0.0)
    cdf = np.concatenate((lengths.cdf, np.ones(max(0, n + 2 - len(lengths.pdf)))))
    fits = cdf[1 : n + 2] / np.arange(1, n + 2)  # fits[h - 1]: selected from a piece of h bases
    u = np.arange(n)
    to_end = fits[n - u]
    whole = run(np.array(n - 1)) / n * to_end
    j = np.arange(1, n)
    left_piece = np.concatenate((run(j - 1) / j, [0.0]))  # [j - 1]: the piece ends before base j
    h = min(most, n)
    left = np.correlate(np.concatenate((left_piece, np.zeros(h))), fits[:h])[:n] * p if n > 1 else np.zeros(n)
    right_piece = np.concatenate(([0.0], np.cumsum(run(n - u - 1) / (n - u))))
    right = p * (right_piece[u] - right_piece[np.maximum(0, u - most)]) * to_end
    between = np.zeros(n)
    if min(most, n) > 1:
        reach = np.arange(1, min(most, n))
        chance = fits[reach - 1]
        sums = summed[np.minimum(np.arange(1, n), most - 1)]  # [m - 1]
        ahead = np.correlate(np.concatenate((sums, np.zeros(len(reach)))), chance)[:n]
        own = np.concatenate(([0.0], np.cumsum(chance * summed[reach])))
        between = p * p * (ahead - own[np.minimum(len(reach), np.maximum(0, n - u - 1))])
    return FRAGMENTATION_SCALE * (whole + left + right + between) / cdf[n - u]
