"""Distributions, tests and log-space arithmetic, in plain Python for the driver and for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, fsum, inf, lgamma, log, log1p, pi, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 <= k <= n else -inf


def log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    low, high = min(a, b), max(a, b)
    return high if low == -inf else high + log1p(exp(low - high))


def binomial(n: int, k: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == n * p)
    return exp(log_choose(n, k) + k * log(p) + (n - k) * log1p(-p)) if 0 <= k <= n else 0.0


def binomial_right_tail(n: int, k: int, p: float) -> float:
    """P(X >= k)."""
    return min(1.0, fsum(binomial(n, i, p) for i in range(max(k, 0), n + 1)))


def binomial_left_tail(n: int, k: int, p: float) -> float:
    """P(X <= k)."""
    return min(1.0, fsum(binomial(n, i, p) for i in range(0, min(k, n) + 1)))


def poisson(k: int, rate: float) -> float:
    return exp(k * log(rate) - rate - lgamma(k + 1)) if rate > 0 else float(k == 0)


def poisson_right_tail(k: int, rate: float) -> float:
    return max(0.0, 1.0 - fsum(poisson(i, rate) for i in range(k)))


def normal(x: float, mean: float, sd: float) -> float:
    return exp(-((x - mean) ** 2) / (2 * sd * sd)) / (sd * sqrt(2 * pi))


def normal_right_tail(x: float, mean: float, sd: float) -> float:
    return 0.5 * erfc((x - mean) / (sd * sqrt(2)))


def beta_density(x: float, a: float, b: float) -> float:
    return exp((a - 1) * log(x) + (b - 1) * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b))


def gamma_density(x: float, shape: float, rate: float) -> float:
    return exp(shape * log(rate) + (shape - 1) * log(x) - rate * x - lgamma(shape))


def fisher_exact(a: int, b: int, c: int, d: int, greater: bool = True) -> float:
    """One-sided P for the table ((a, b), (c, d)): a at least (greater) or at most as large, margins fixed."""
    row, col, n = a + b, a + c, a + b + c + d
    base = log_choose(n, col)
    span = range(a, min(row, col) + 1) if greater else range(max(0, col - (n - row)), a + 1)
    return min(1.0, fsum(exp(log_choose(row, i) + log_choose(n - row, col - i) - base) for i in span))


def poisson_binomial_right_tail(probabilities: list[float], k: int) -> float:
    """P(at least k successes) of independent trials; exact, by one pass over the trials."""
    dist = [1.0]
    for p in probabilities:
        dist = [x * (1 - p) + (dist[i - 1] * p if i else 0.0) for i, x in enumerate([*dist, 0.0])]
    return fsum(dist[k:])


def integrate(f, low: float, high: float, steps: int = 1000) -> float:
    """Simpson's rule."""
    steps += steps % 2
    h = (high - low) / steps
    return h / 3 * fsum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(low + i * h) for i in range(steps + 1))


def golden_section_max(f, low: float, high: float, tolerance: float = 1e-8) -> float:
    """Where a unimodal function is largest."""
    g = (sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
        else:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
    return (low + high) / 2


def _each(f, *columns: Column) -> Column:
    """f of the columns' values, in Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([f(*row) for row in zip(*series, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(*columns)


def fisher_exact_column(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _each(lambda *row: fisher_exact(*map(int, row)), a, b, c, d)


def binomial_tail_column(n: Column, k: Column, p: Column) -> Column:
    return _each(lambda x, y, z: binomial_right_tail(int(x), int(y), float(z)), n, k, p)
