"""Log densities with their derivatives, in numpy.

``Gamma(mean, shape)`` has scale mean/shape; ``gamma_rate`` has a rate. Each function
returns the log density, or its derivative in x where the name ends in ``_dx``.
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def lgamma(x):
    return np.asarray(_lgamma(x), dtype=float)


def digamma(x):
    """Recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    x = x.copy()
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def gamma_rate(x, shape, rate):
    return shape * np.log(rate) - lgamma(shape) + (shape - 1) * np.log(x) - rate * x


def gamma_rate_dx(x, shape, rate):
    return (shape - 1) / x - rate


def gamma_mean(x, mean, shape):
    return gamma_rate(x, shape, shape / mean)


def gamma_mean_dx(x, mean, shape):
    return gamma_rate_dx(x, shape, shape / mean)


def gamma_mean_dmean(x, mean, shape):
    return shape * (x - mean) / (mean * mean)


def gamma_mean_dshape(x, mean, shape):
    return np.log(shape / mean) + 1 - digamma(shape) + np.log(x) - x / mean


def poisson(k, rate):
    return k * np.log(rate) - rate - lgamma(k + 1.0)


def poisson_drate(k, rate):
    return k / rate - 1


def normal(x, mu, sigma):
    return -HALF_LOG_TAU - np.log(sigma) - 0.5 * ((x - mu) / sigma) ** 2


def normal_dx(x, mu, sigma):
    return (mu - x) / sigma**2


def normal_dsigma(x, mu, sigma):
    return ((x - mu) ** 2 / sigma**2 - 1) / sigma


def log_normal(x, mu, sigma):
    return normal(np.log(x), mu, sigma) - np.log(x)


def student_t(x, nu, mu, sigma):
    z = (x - mu) / sigma
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - np.log(sigma) - (nu + 1) / 2 * np.log1p(z * z / nu)


def student_t_dx(x, nu, mu, sigma):
    z = (x - mu) / sigma
    return -(nu + 1) * z / ((nu + z * z) * sigma)


def inverse_gamma(x, a, b):
    return a * np.log(b) - lgamma(a) - (a + 1) * np.log(x) - b / x


def squared_inverse_gamma(x, a, b):
    """Density of x where x squared is inverse gamma."""
    return inverse_gamma(x * x, a, b) + np.log(2 * x)


def beta(x, a, b):
    return lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)


def dirichlet(x, a):
    return float(lgamma(a.sum()) - lgamma(a).sum() + ((a - 1) * np.log(x)).sum())


def logistic_normal(x, mu, sigma):
    """Of shares x (they sum to one): normal log ratios to the last share."""
    y = np.log(x[:-1] / x[-1])
    return float(normal(y, mu, sigma).sum() - np.log(x).sum())
