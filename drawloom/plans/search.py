"""Searching for window configurations: samplers on the driver, each trial a distributed sieve.

A trial runs the forward pass; only if it leaves survivors, the reverse pass; then their summary. Trials are kept as rows. Samplers
draw from bounds: at random, by a tree of Parzen-like good and bad trials, or by an upper confidence bound over a kernel fit.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from drawloom.operators import sieve as S
from drawloom.operators.windows import window_scan


@dataclass(frozen=True)
class Config:
    window_size: int
    offset: int
    skip_min: int
    skip_max: int
    forward_threshold: float
    reverse_threshold: float


@dataclass(frozen=True)
class Bounds:
    window_size: tuple[int, int] = (4, 32)
    offset: tuple[int, int] = (0, 100)
    skip_min: tuple[int, int] = (0, 5)
    skip_max: tuple[int, int] = (5, 15)
    forward_threshold: tuple[float, float] = (0.1, 0.4)
    reverse_threshold: tuple[float, float] = (0.1, 0.4)

    def clip(self, v: dict[str, float]) -> Config:
        out = {}
        for k, (lo, hi) in asdict(self).items():
            x = min(hi, max(lo, v[k]))
            out[k] = int(round(x)) if isinstance(lo, int) else float(x)
        return Config(**out)

    def valid(self, c: Config) -> bool:
        return all(lo <= getattr(c, k) <= hi for k, (lo, hi) in asdict(self).items()) and c.skip_min <= c.skip_max


Sampler = Callable[[Bounds, list[tuple[Config, float]], random.Random], Config]


def random_sampler(b: Bounds, seen: list[tuple[Config, float]], rnd: random.Random) -> Config:
    return b.clip({k: rnd.uniform(lo, hi) for k, (lo, hi) in asdict(b).items()})


def parzen_sampler(b: Bounds, seen: list[tuple[Config, float]], rnd: random.Random, start: int = 5, share: float = 0.25, tries: int = 24) -> Config:
    """Candidates near good trials, the one of the best density ratio of good to bad."""
    if len(seen) < start:
        return random_sampler(b, seen, rnd)
    ranked = sorted(seen, key=lambda s: -s[1])
    n = max(1, math.ceil(share * len(ranked)))
    good, bad = [c for c, _ in ranked[:n]], [c for c, _ in ranked[n:]]

    def density(c: Config, group: list[Config]) -> float:
        z = [sum(((getattr(c, k) - getattr(g, k)) / max(1e-9, (hi - lo) / 5)) ** 2 for k, (lo, hi) in asdict(b).items()) for g in group]
        return sum(math.exp(-x / 2) for x in z) / max(1, len(group)) + 1e-12

    cand = [b.clip({k: rnd.gauss(getattr(g, k), (hi - lo) / 8) for k, (lo, hi) in asdict(b).items()}) for g in (rnd.choice(good) for _ in range(tries))]
    return max(cand, key=lambda c: density(c, good) / density(c, bad))


def ucb_sampler(b: Bounds, seen: list[tuple[Config, float]], rnd: random.Random, start: int = 5, tries: int = 200, kappa: float = 2.0) -> Config:
    """The candidate of the highest mean plus kappa spreads of a Gaussian process over the trials."""
    if len(seen) < start:
        return random_sampler(b, seen, rnd)
    unit = lambda c: np.array([(getattr(c, k) - lo) / max(1e-9, hi - lo) for k, (lo, hi) in asdict(b).items()])
    x, y = np.stack([unit(c) for c, _ in seen]), np.array([s for _, s in seen])
    kern = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / (2 * 0.3**2))
    inv = np.linalg.inv(kern(x, x) + 1e-4 * np.eye(len(x)))
    cand = [random_sampler(b, seen, rnd) for _ in range(tries)]
    z = np.stack([unit(c) for c in cand])
    k = kern(z, x)
    mean = k @ inv @ (y - y.mean()) + y.mean()
    sd = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, inv, k), 0)) * (y.std() + 1e-9)
    return cand[int(np.argmax(mean + kappa * sd))]


#: How a trial's summary becomes a score.
SCORES: dict[str, Callable[[dict], float]] = {
    "bidirectional": lambda r: float(r["bidirectional_count"]),
    "balanced": lambda r: r["bidirectional_count"] * (0.5 * r["precision"] + 0.5 * r["recall"]),
    "conservative": lambda r: r["bidirectional_count"] * min(r["precision"], r["recall"]),
}


def run_trial(draws: DataFrame, seeds: DataFrame, family: str, c: Config) -> dict:
    """One configuration; without forward survivors the reverse pass is not run."""
    values = [r.draw for r in window_scan(draws, c.window_size, c.offset).orderBy("pos").select("draw").collect()]
    none = {"forward_count": 0, "reverse_count": 0, "bidirectional_count": 0, "precision": 0.0, "recall": 0.0, "jaccard": 0.0, "pruned": True}
    if not values:
        return none
    fwd = S.fixed_skip(seeds, values, family, (c.skip_min, c.skip_max), c.forward_threshold)
    if fwd.isEmpty():
        return none
    rev = S.fixed_skip(seeds, values, family, (c.skip_min, c.skip_max), c.reverse_threshold, reverse=True)
    return {**S.trial_summary(fwd, rev).first().asDict(), "pruned": False}


def search(spark: SparkSession, draws: DataFrame, seeds: DataFrame, family: str, trials: int, sampler: Sampler = random_sampler, score: str = "bidirectional", bounds: Bounds = Bounds(), seed: int = 1) -> DataFrame:
    """All trials as rows, each with its score and the best so far."""
    rnd, seen, rows = random.Random(seed), [], []
    draws = draws.persist()
    for t in range(trials):
        c = sampler(bounds, seen, rnd)
        r = run_trial(draws, seeds, family, c)
        s = SCORES[score](r)
        seen.append((c, s))
        rows.append((t, *asdict(c).values(), r["forward_count"], r["reverse_count"], r["bidirectional_count"], r["pruned"], s, max(x for _, x in seen)))
    draws.unpersist()
    return spark.createDataFrame(rows, "trial_number int, window_size int, offset int, skip_min int, skip_max int, forward_threshold double, reverse_threshold double, forward_count bigint, reverse_count bigint, bidirectional_count bigint, pruned boolean, score double, best_so_far double")
