"""Parameters of generators from their outputs, and the full battery of statistics of a few generated sequences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.operators import generators as G


def shortest_register(bits: list[int]) -> list[int] | None:
    """Taps of the shortest linear feedback register that gives the bits (bit n is the sum of the bits n - t), if at least half of the bits confirm it."""
    c, b, size, m = [1], [1], 0, 1
    for n in range(len(bits)):
        d = bits[n]
        for i in range(1, size + 1):
            if i < len(c) and c[i]:
                d ^= bits[n - i]
        if not d:
            m += 1
            continue
        t = c[:]
        c += [0] * max(0, len(b) + m - len(c))
        for i, x in enumerate(b):
            c[i + m] ^= x
        if 2 * size <= n:
            size, b, m = n + 1 - size, t, 1
        else:
            m += 1
    return [i for i in range(1, size + 1) if i < len(c) and c[i]] if 2 * size <= len(bits) else None


def lagged_pair(values: list[int], m: int, most: int = 64) -> tuple[int, int] | None:
    """Lags j < k with x(n) = x(n - j) + x(n - k) mod m for all n that have both; the least k, then j. None without any, or with fewer than eight tests."""
    v = np.array(values, np.int64) % m
    for k in range(2, min(most, len(v) - 8) + 1):
        for j in range(1, k):
            if ((v[k - j : len(v) - j] + v[: len(v) - k]) % m == v[k:]).all():
                return j, k
    return None


def xorshift_shifts(values: list[int]) -> tuple[int, int, int] | None:
    """Shifts (left, right, left) of a 32-bit xorshift whose whole outputs are given, the first of those that fit; from three outputs on."""
    x = np.array(values, np.uint64) & G.M32
    if len(x) < 3:
        return None
    s = np.arange(1, 32, dtype=np.uint64)
    a, b, c = (g.ravel() for g in np.meshgrid(s, s, s, indexing="ij"))
    for u, v in zip(x[:-1], x[1:]):
        y = u ^ ((u << a) & G.M32)
        y = y ^ (y >> b)
        y = y ^ ((y << c) & G.M32)
        ok = y == v
        a, b, c = a[ok], b[ok], c[ok]
    return (int(a[0]), int(b[0]), int(c[0])) if len(a) else None


def per_group(df: DataFrame, by: str, order: str, value: str, fn: Callable[[list[int]], object]) -> DataFrame:
    """by, found, parameters (array) of ``fn`` over each group's outputs in order. Groups are a few outputs of one seed."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = fn([int(x) for x in pdf.sort_values(order)[value]])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "found": [r is not None], "parameters": [list(r) if r is not None else None]})

    return df.select(by, order, value).groupBy(by).applyInPandas(one, f"{by} {df.schema[by].dataType.simpleString()}, found boolean, parameters array<int>")


def _two_sided(z: float) -> float:
    return 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))


def statistics(x: np.ndarray, buckets: int = 100) -> dict[str, float]:
    """chi2 over equal buckets with its p (by the cube-root normal approximation), runs around the median with their p, correlation at lags 1 and 5, and
    the composite: a quarter of each p and of each correlation's size. Constant sequences give 0 and 1."""
    n, lo, hi = len(x), float(x.min()), float(x.max())
    chi, p_chi = 0.0, 1.0
    if hi > lo:
        c = np.histogram(x, np.linspace(lo, hi + 1, buckets + 1))[0]
        chi, nu = float(((c - n / buckets) ** 2 / (n / buckets)).sum()), buckets - 1
        p_chi = _two_sided(((chi / nu) ** (1 / 3) - (1 - 2 / (9 * nu))) / math.sqrt(2 / (9 * nu)))
    up = x >= np.median(x)
    a, b = int(up.sum()), int((~up).sum())
    runs, p_runs = float(n), 1.0
    if a and b:
        runs = int((up[1:] != up[:-1]).sum()) + 1
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1) + 1e-9)
        p_runs = _two_sided((runs - 1 - 2 * a * b / n) / math.sqrt(max(var, 1e-12)))
    d, v = x - x.mean(), x.var() + 1e-12
    r = {k: float((d[k:] * d[:-k]).sum() / ((n - k) * v)) for k in (1, 5)}
    return {"chi2": chi, "chi2_p": p_chi, "runs": float(runs), "runs_p": p_runs, "lag1": r[1], "lag5": r[5], "composite": (p_chi + p_runs + abs(r[1]) + abs(r[5])) / 4}


STATISTICS = ["chi2", "chi2_p", "runs", "runs_p", "lag1", "lag5", "composite"]


def exhaustive(seeds: DataFrame, family: str, n: int, mod: int = 1000) -> DataFrame:
    """seed and STATISTICS of the first n outputs of each seed: a map over seeds, of any number."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, 256):
            s = pdf["seed"].to_numpy()
            x = (G.sequences(family, s, n) % G.U64(mod)).astype(float)
            yield pd.DataFrame({"seed": s, **{k: [r[k] for r in rows] for rows in [[statistics(v) for v in x]] for k in STATISTICS}})

    return seeds.select("seed").mapInPandas(run, "seed bigint, " + ", ".join(f"{k} double" for k in STATISTICS))


def composite_of(stats: DataFrame) -> DataFrame:
    """The mean composite of several seeds."""
    return stats.agg(F.count(F.lit(1)).alias("seeds"), F.avg("composite").alias("composite"))
