"""The hierarchical sampler: components within samples, then conditions, then the experiment.

A round is a few jobs over DataFrames of parameters. Fragment likelihoods stay where they
are, grouped by (sample, component); only parameters move. Every random number is a
function of (seed, round, row), so any number of partitions gives the same draws. Each
round's state is written to the store, which is also where the next one reads it from: a
lost executor costs the tasks it ran and no draw.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import densities as D
from .slice import Counter, maximum, sample

#: The default seed, the least probability of a fragment, and the default priors below.
SEED = 0xACA430B9
EPSILON = 1e-14


@dataclass
class Priors:
    experiment_mean0: float = 2e-4
    experiment_shape0: float = 0.005
    experiment_shape: float = 1.0
    condition_shape_alpha: float = 3.0
    shape_beta_alpha: float = 5.0
    shape_beta_beta: float = 0.01
    splice_mu0: float = 0.5
    splice_sigma0: float = 1.0
    splice_nu: float = 100.0
    splice_alpha: float = 3.0
    least_splice_sigma: float = 0.03
    least_expression: float = 2e-7


@dataclass
class Sparse:
    """Weights of a component's transcripts over its fragments: those of transcript t are ``columns`` and ``values`` from ``ptr[t]`` to ``ptr[t + 1]``."""

    ptr: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    fragments: int

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, fragments: int) -> Sparse:
        order = np.lexsort((column, row))
        return Sparse(np.searchsorted(row[order], np.arange(rows + 1)), column[order], value[order], fragments)

    @staticmethod
    def dense(matrix: np.ndarray) -> Sparse:
        row, column = np.nonzero(matrix)
        return Sparse.of(row, column, matrix[row, column], *matrix.shape)

    def row(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ptr[t], self.ptr[t + 1])
        return self.columns[own], self.values[own]


def component_draw(
    weights: Sparse | np.ndarray, tmix: np.ndarray, cmix: float, rng: Counter, prior_mean: np.ndarray | None, prior_shape: np.ndarray | None, effective: np.ndarray, total: float, optimise: bool = False
) -> tuple[np.ndarray, float]:
    """One update of a component: pairs of transcripts trade mixture mass, then the component's abundance.

    weights: transcripts by fragments; a pair looks at no fragment but its own. With
    ``optimise`` each step goes to its density's maximum instead of drawing from it. Returns
    the new mixture and abundance.
    """
    if isinstance(weights, np.ndarray):
        weights = Sparse.dense(weights)
    n = len(tmix)
    tmix = tmix.copy()
    order = np.argsort(np.array([rng.uniform()[0] for _ in range(n)])) if n > 1 else np.zeros(1, int)
    mix = np.zeros(weights.fragments)
    np.add.at(mix, weights.columns, np.repeat(tmix, np.diff(weights.ptr)) * weights.values)
    for a, b in zip(order, np.roll(order, -1), strict=True):
        if a == b or (n == 2 and a > b):
            continue
        both = tmix[a] + tmix[b]
        if both <= 0:
            continue
        (column_a, value_a), (column_b, value_b) = weights.row(a), weights.row(b)
        at = np.union1d(column_a, column_b)
        w = np.zeros((2, len(at)))
        w[0, np.searchsorted(at, column_a)], w[1, np.searchsorted(at, column_b)] = value_a, value_b
        rest = mix[at] - tmix[a] * w[0] - tmix[b] * w[1]

        def density(x: np.ndarray) -> np.ndarray:
            share = np.stack((x, 1 - x), axis=1) * both
            out = np.log(np.maximum(rest + share @ w, EPSILON)).sum(axis=1)
            if prior_mean is not None:
                value = np.maximum(share * cmix / effective[[a, b]] / total, 1e-300)
                out = out + D.gamma_mean(value, prior_mean[[a, b]], prior_shape[[a, b]]).sum(axis=1)
            return out

        x = maximum(density, 1, 1e-9, 1 - 1e-9)[0] if optimise else sample(density, np.array([tmix[a] / both]), 0.0, 1.0, rng)[0]
        tmix[a], tmix[b] = x * both, (1 - x) * both
        mix[at] = rest + tmix[a] * w[0] + tmix[b] * w[1]
    return tmix, abundance_draw(weights.fragments, tmix, cmix, rng, prior_mean, prior_shape, effective, total, optimise)


def abundance_draw(fragments: int, tmix: np.ndarray, cmix: float, rng: Counter, prior_mean: np.ndarray | None, prior_shape: np.ndarray | None, effective: np.ndarray, total: float, optimise: bool = False) -> float:
    """The abundance of a component of ``fragments`` with a given mixture."""

    def abundance(c: np.ndarray) -> np.ndarray:
        out = D.poisson(float(fragments), c)
        if prior_mean is not None:
            value = np.maximum(c[:, None] * tmix / effective / total, 1e-300)
            out = out + D.gamma_mean(value, prior_mean, prior_shape).sum(axis=1)
        return out

    most = 10.0 * (fragments + 10)
    return float(maximum(abundance, 1, 1e-9, most)[0] if optimise else sample(abundance, np.array([cmix]), 1e-9, most, rng, width=np.sqrt(fragments + 1.0))[0])


def sample_components(weights: DataFrame, state: DataFrame, seed: int, round_: int, use_priors: bool, optimise: bool = False) -> DataFrame:
    """One round over all components: (sample, component, tid, tmix, cmix).

    weights: (sample, component, tid, frag, w); state: (sample, component, tid, tmix, cmix,
    effective, total, prior_mean, prior_shape). A component is one group, held as sparse rows; larger ones are drawn by ``giants``.
    """

    def run(key: tuple, w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({c: [] for c in ("sample", "component", "tid", "tmix", "cmix")})
        s = s.sort_values("tid")
        tids = s["tid"].to_numpy()
        frags, column = np.unique(w["frag"].to_numpy(), return_inverse=True)
        matrix = Sparse.of(np.searchsorted(tids, w["tid"].to_numpy()), column, w["w"].to_numpy(), len(tids), len(frags))
        rng = Counter(seed, round_, np.array([hash_pair(*map(int, key))]))
        mean, shape = (s["prior_mean"].to_numpy(), s["prior_shape"].to_numpy()) if use_priors else (None, None)
        tmix, cmix = component_draw(matrix, s["tmix"].to_numpy(), float(s["cmix"].iloc[0]), rng, mean, shape, s["effective"].to_numpy(), float(s["total"].iloc[0]), optimise)
        return pd.DataFrame({"sample": s["sample"], "component": s["component"], "tid": tids, "tmix": tmix, "cmix": cmix})

    state = state.select(*[F.col(c).alias(c) for c in state.columns])
    grouped = weights.groupBy("sample", "component").cogroup(state.groupBy("sample", "component"))
    return grouped.applyInPandas(run, "sample int, component long, tid int, tmix double, cmix double")


def hash_pair(a: int, b: int) -> int:
    return int(np.int64(np.uint64((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % (1 << 64))))


def sample_means(values: DataFrame, state: DataFrame, seed: int, round_: int, shape_beta: float, priors: Priors, use_priors: bool = True) -> DataFrame:
    """Condition means and shapes, then the experiment mean, of each transcript.

    values: (tid, condition, sample, value); state: (tid, condition, mean, shape, experiment_mean).
    Returns the new state. Rows of a transcript are one group; blocks of transcripts share a task.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tid = int(batch["tid"].iloc[0])
        batch = batch.sort_values(["condition", "sample"])
        cond, index = np.unique(batch["condition"].to_numpy(), return_inverse=True)
        value = np.maximum(batch["value"].to_numpy(), 1e-12)
        mean = batch.groupby("condition")["mean"].first().to_numpy()
        shape, experiment = float(batch["shape"].iloc[0]), float(batch["experiment_mean"].iloc[0])
        rng = Counter(seed, round_, np.full(len(cond), tid) * 1000 + cond)

        def of_mean(m: np.ndarray) -> np.ndarray:
            inner = np.bincount(index, weights=D.gamma_mean(value, m[index], shape), minlength=len(cond))
            return inner + (D.gamma_mean(m, experiment, priors.experiment_shape) if use_priors else 0.0)

        mean = sample(of_mean, mean, 1e-12, 1.0, rng, width=np.maximum(mean, 1e-9))
        one = Counter(seed + 1, round_, np.array([tid]))
        if use_priors:
            shape = float(sample(lambda s: np.array([D.gamma_mean(value, mean[index], v).sum() + D.gamma_rate(v, priors.condition_shape_alpha, shape_beta) for v in s]), np.array([shape]), 0.1, 5.0, one)[0])
        n = max(len(cond), 1)
        experiment = float(
            sample(lambda e: np.array([D.gamma_mean(mean, v, priors.experiment_shape).sum() + D.gamma_mean(v, priors.experiment_mean0 / n, priors.experiment_shape0) for v in e]), np.array([experiment]), 1e-12, 1.0, one, width=max(experiment, 1e-9))[0]
        )
        return pd.DataFrame({"tid": np.int32(tid), "condition": cond.astype(np.int32), "mean": mean, "shape": shape, "experiment_mean": experiment})

    joined = values.join(state, ["tid", "condition"])
    return joined.groupBy("tid").applyInPandas(run, "tid int, condition int, mean double, shape double, experiment_mean double")


def sample_splicing(shares: DataFrame, state: DataFrame, seed: int, round_: int, beta: float, sigma: float, priors: Priors) -> DataFrame:
    """Condition splice means, their spread, and the experiment's, of each spliced transcript.

    shares: (tid, condition, sample, value); state: (tid, condition, mu, spread, experiment_mu).
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tid = int(batch["tid"].iloc[0])
        batch = batch.sort_values(["condition", "sample"])
        cond, index = np.unique(batch["condition"].to_numpy(), return_inverse=True)
        value = batch["value"].to_numpy()
        mu = batch.groupby("condition")["mu"].first().to_numpy()
        spread, experiment = float(batch["spread"].iloc[0]), float(batch["experiment_mu"].iloc[0])
        rng = Counter(seed + 2, round_, np.full(len(cond), tid) * 1000 + cond)
        mu = sample(lambda m: np.bincount(index, weights=D.normal(value, m[index], spread), minlength=len(cond)) + D.student_t(m, priors.splice_nu, experiment, sigma), mu, -1.0, 2.0, rng, width=0.1)
        one = Counter(seed + 3, round_, np.array([tid]))
        spread = float(
            sample(lambda s: np.array([D.normal(value, mu[index], v).sum() + D.gamma_rate(v, priors.splice_alpha, beta) for v in s]), np.array([spread]), priors.least_splice_sigma, 5.0, one, width=0.1)[0]
        )
        experiment = float(
            sample(lambda e: np.array([D.student_t(mu, priors.splice_nu, v, sigma).sum() + D.normal(v, priors.splice_mu0, priors.splice_sigma0) for v in e]), np.array([experiment]), -1.0, 2.0, one, width=0.1)[0]
        )
        return pd.DataFrame({"tid": np.int32(tid), "condition": cond.astype(np.int32), "mu": mu, "spread": spread, "experiment_mu": experiment})

    return shares.join(state, ["tid", "condition"]).groupBy("tid").applyInPandas(run, "tid int, condition int, mu double, spread double, experiment_mu double")


def sample_beta(state: DataFrame, column: str, alpha: float, prior_alpha: float, prior_beta: float, beta: float, seed: int, round_: int) -> float:
    """Rate of the gamma prior of ``column`` over transcripts: two sums are all that reaches the driver."""
    n, total = state.select("tid", column).distinct().agg(F.count(F.lit(1)), F.sum(column)).first()
    rng = Counter(seed + 5, round_, np.array([len(column)]))
    if not n:
        return beta
    density = lambda b: n * alpha * np.log(b) - b * total + D.gamma_rate(b, prior_alpha, prior_beta)
    return float(sample(density, np.array([beta]), 1e-6, 1e6, rng, width=max(beta, 1.0))[0])


def sample_sigma(state: DataFrame, sigma: float, seed: int, round_: int, alpha: float = 5.0, rate: float = 10.0) -> float:
    """Spread of condition splice means around the experiment's."""
    n, squares = state.agg(F.count(F.lit(1)), F.sum((F.col("mu") - F.col("experiment_mu")) ** 2)).first()
    rng = Counter(seed + 6, round_, np.array([0]))
    if not n:
        return sigma
    density = lambda s: -n * np.log(s) - 0.5 * squares / s**2 + D.gamma_rate(s, alpha, rate)
    return float(sample(density, np.array([sigma]), 1e-3, 10.0, rng, width=0.1)[0])
