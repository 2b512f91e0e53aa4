"""Components too large for one task, drawn by assigning their fragments.

Given a mixture, each fragment is assigned to one of its transcripts (or, where the maximum is looked for,
shared among them by probability); given how many each transcript got, a pair of transcripts
trades mixture mass without looking at any fragment, and pairs without a transcript in common do so at once. Both steps are
exact conditionals of the same posterior that ``gibbs.component_draw`` draws from, so the draws have the same
distribution. Fragments are rows that Spark deals by key; what one task holds of a component is a row a transcript.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import densities as D
from . import gibbs
from .slice import Counter, maximum, sample

#: Weights (fragments by transcripts) of a component from which on it is drawn this way.
LARGEST = 1 << 20
#: Assignments of a round: they mix more slowly than pairs that see the fragments.
SWEEPS = 2
KEY = ["sample", "component"]


def split(weights: DataFrame, largest: int = LARGEST) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Weights of the components that fit a task, those of the others, and the others' keys; None if there are none."""
    keys = checkpointed(weights.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select(*KEY))
    if keys.isEmpty():
        return weights, None, None
    return weights.join(keys, KEY, "left_anti"), checkpointed(weights.join(keys, KEY, "left_semi")), keys


def assigned(weights: DataFrame, state: DataFrame, seed: int, round_: int, optimise: bool) -> DataFrame:
    """(sample, component, tid, got): fragments of each transcript, drawn, or with ``optimise`` expected."""
    rows = weights.join(state.select(*KEY, "tid", "tmix"), [*KEY, "tid"])
    rows = rows.select(*KEY, "tid", "frag", F.greatest(F.col("tmix") * F.col("w"), F.lit(1e-300)).alias("p"))
    if optimise:
        # a fragment has a handful of transcripts
        shares = rows.select(*KEY, "tid", (F.col("p") / F.sum("p").over(Window.partitionBy(*KEY, "frag"))).alias("got"))
        return shares.groupBy(*KEY, "tid").agg(F.sum("got").alias("got"))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(round_), *KEY, "frag", "tid"), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    # the greatest of log p plus Gumbel noise is a draw by p
    drawn = rows.groupBy(*KEY, "frag").agg(F.max_by("tid", F.struct(F.log("p") - F.log(-F.log(uniform)), "tid")).alias("tid"))
    return drawn.groupBy(*KEY, "tid").agg(F.count(F.lit(1)).cast("double").alias("got"))


def traded(got: np.ndarray, tmix: np.ndarray, cmix: float, keys: np.ndarray, seed: int, round_: int, mean: np.ndarray | None, shape: np.ndarray | None, effective: np.ndarray, total: float, optimise: bool) -> np.ndarray:
    """The mixture after each transcript traded with two others, given the fragments that each has."""
    tmix, n = tmix.copy(), len(tmix)
    order = np.argsort(Counter(seed, round_, keys).uniform())
    for turn in range(1 if n == 2 else 2):
        ring = np.roll(order, -turn)
        a, b = ring[0 : n - 1 : 2], ring[1:n:2]
        if not len(a):
            continue
        both = tmix[a] + tmix[b]

        def density(x: np.ndarray, a=a, b=b, both=both) -> np.ndarray:
            x = np.clip(x, 1e-12, 1 - 1e-12)
            out = got[a] * np.log(x) + got[b] * np.log1p(-x)
            if mean is not None:
                for t, share in ((a, x), (b, 1 - x)):
                    out = out + D.gamma_mean(np.maximum(share * both * cmix / effective[t] / total, 1e-300), mean[t], shape[t])
            return out

        rng = Counter(seed + 11 + turn, round_, keys[a])
        x = maximum(density, len(a), 1e-9, 1 - 1e-9) if optimise else sample(density, tmix[a] / both, 0.0, 1.0, rng)
        tmix[a], tmix[b] = x * both, (1 - x) * both
    return tmix


def sample_giants(weights: DataFrame, state: DataFrame, seed: int, round_: int, use_priors: bool, optimise: bool = False, sweeps: int = SWEEPS) -> DataFrame:
    """One round over the large components, with the arguments and rows of ``gibbs.sample_components``."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in state.schema]

    def drawn(number: int):
        def run(s: pd.DataFrame) -> pd.DataFrame:
            s = s.sort_values("tid")
            key = gibbs.hash_pair(int(s["sample"].iloc[0]), int(s["component"].iloc[0]))
            mean, shape = (s["prior_mean"].to_numpy(), s["prior_shape"].to_numpy()) if use_priors else (None, None)
            tmix, cmix, got, effective, total = s["tmix"].to_numpy(), float(s["cmix"].iloc[0]), s["got"].to_numpy(), s["effective"].to_numpy(), float(s["total"].iloc[0])
            with np.errstate(over="ignore"):
                keys = s["tid"].to_numpy().astype(np.int64) + np.int64(key)
            if len(tmix) > 1:
                tmix = traded(got, tmix, cmix, keys, seed, number, mean, shape, effective, total, optimise)
            cmix = gibbs.abundance_draw(round(got.sum()), tmix, cmix, Counter(seed + 13, number, np.array([key])), mean, shape, effective, total, optimise)
            return s.drop(columns="got").assign(tmix=tmix, cmix=cmix)

        return run

    for sweep in range(sweeps):
        number = round_ * sweeps + sweep
        counts = assigned(weights, state, seed, number, optimise)
        rows = state.join(counts, [*KEY, "tid"], "left").select(*state.columns, F.coalesce("got", F.lit(0.0)).alias("got"))
        state = checkpointed(rows.groupBy(*KEY).applyInPandas(drawn(number), ", ".join(names)))
    return state.select(*KEY, "tid", "tmix", "cmix")
