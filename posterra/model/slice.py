"""Slice sampling of many independent one-dimensional densities at once.

State and random numbers are arrays over rows. Each row's numbers come from a counter: a
hash of (seed, round, row key, draw number), so results do not depend on how rows are dealt
to partitions or in which order they come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Counter:
    """Uniform numbers by row key; every call moves the counter."""

    def __init__(self, seed: int, round_: int, keys: np.ndarray):
        self.state = self._mix(self._mix(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(seed % (1 << 64))) ^ np.uint64(round_ * int(_GOLD) % (1 << 64)))
        self.n = 0

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def uniform(self) -> np.ndarray:
        """In the open interval (0, 1)."""
        self.n += 1
        bits = self._mix(self.state + np.uint64(self.n * int(_GOLD) % (1 << 64)))
        return ((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def sample(log_density: Callable[[np.ndarray], np.ndarray], x: np.ndarray, lower: float, upper: float, rng: Counter, width: float | np.ndarray | None = None, most_steps: int = 64) -> np.ndarray:
    """One slice update of every row: step out by doubling widths, then shrink."""
    x = np.clip(np.asarray(x, dtype=float), np.nextafter(lower, upper), np.nextafter(upper, lower))
    level = log_density(x) + np.log(rng.uniform())
    w = np.broadcast_to(np.asarray((upper - lower) / 10 if width is None else width, dtype=float), x.shape).copy()
    left = x - w * rng.uniform()
    right = left + w
    for side in (-1, 1):
        edge = left if side < 0 else right
        step = w.copy()
        open_ = np.ones(len(x), dtype=bool)
        for _ in range(most_steps):
            edge = np.clip(edge, lower, upper)
            inside = (edge > lower) & (edge < upper)
            at = np.where(inside, edge, x)
            open_ &= inside & (log_density(at) > level)
            if not open_.any():
                break
            edge = np.where(open_, edge + side * step, edge)
            step = np.where(open_, 2 * step, step)
        edge = np.clip(edge, lower, upper)
        if side < 0:
            left = edge
        else:
            right = edge
    out, todo = x.copy(), np.ones(len(x), dtype=bool)
    for _ in range(200):
        u = left + rng.uniform() * (right - left)
        u = np.where((u > lower) & (u < upper), u, x)
        ok = todo & (log_density(u) >= level)
        out[ok] = u[ok]
        todo &= ~ok
        if not todo.any():
            break
        left = np.where(todo & (u < x), u, left)
        right = np.where(todo & (u >= x), u, right)
    return out


def maximum(log_density: Callable[[np.ndarray], np.ndarray], n: int, lower: float, upper: float, rounds: int = 80) -> np.ndarray:
    """Golden-section maximum of each row between the bounds."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = np.full(n, lower), np.full(n, upper)
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = log_density(c), log_density(d)
    for _ in range(rounds):
        left = fc > fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = log_density(c), log_density(d)
    return (a + b) / 2
