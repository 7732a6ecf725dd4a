"""Searching spaces of seeds for those whose outputs match a window of observed values.

A seed's row stands for itself: for each skip its outputs at positions p(i) = offset + skip + i (skip + 1) + 1 are compared with
the values modulo 1000, matches are counted, and the best skip (the lowest one on ties) is kept. So a sieve is a map over a range
of seeds, without any join or shuffle, whatever the size of the space; the values of the window (a parameter's worth) and the jump
constants are literals in it. It runs as NumPy over Arrow batches, all seeds of a batch at once; positions are shared between skips.
Congruential families jump to each position, the others step there. (One generated column expression for all comparisons was
tried: it outgrows the compiler's method limit and was 25 times slower.)

The reverse pass is the same over the values in reverse order. Thresholds are compared as whole matches, ceil(t k).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators import generators as G

SCHEMA = "seed bigint, matches int, best_skip int"


def positions(k: int, skip: int, offset: int = 0, burn_between: bool = True) -> list[int]:
    """Steps from the seed to the output that value i is held against."""
    return [offset + skip + i * (skip + 1 if burn_between else 1) + 1 for i in range(k)]


def least_matches(threshold: float, k: int) -> int:
    return math.ceil(threshold * k - 1e-9)


def seed_space(spark: SparkSession, start: int, end: int, parts: int | None = None) -> DataFrame:
    """The seeds from start to end (exclusive), never stored."""
    return spark.range(start, end, 1, parts).withColumnRenamed("id", "seed") if parts else spark.range(start, end).withColumnRenamed("id", "seed")


def fixed_skip(seeds: DataFrame, values: list[int], family: str, skips: tuple[int, int], threshold: float, offset: int = 0, reverse: bool = False, burn_between: bool = True) -> DataFrame:
    """seed, matches, total, match_rate, best_skip of the seeds whose best skip reaches the threshold."""
    values = [v % 1000 for v in (values[::-1] if reverse else values)]
    k, lo, hi = len(values), *skips
    out = _stepped(seeds, values, family, lo, hi, offset, burn_between)
    need = least_matches(threshold, k)
    return out.where(F.col("matches") >= need).select("seed", "matches", F.lit(k).alias("total"), (F.col("matches") / k).alias("match_rate"), "best_skip")


def _stepped(seeds: DataFrame, values: list[int], family: str, lo: int, hi: int, offset: int, burn: bool) -> DataFrame:
    wanted: dict[int, list[tuple[int, int]]] = {}
    for s in range(lo, hi + 1):
        for p, v in zip(positions(len(values), s, offset, burn), values):
            wanted.setdefault(p, []).append((s - lo, v))
    order, spec = sorted(wanted), G.FAMILIES[family]
    jump = G.jumps(spec.affine, order) if spec.affine else {}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, spec.batch):
            seed = pdf["seed"].to_numpy()
            g, hits, at = spec.for_sieve()(seed), np.zeros((hi - lo + 1, len(seed)), np.int16), 0
            first = g.x % G.U64(spec.affine[2]) if jump else None
            for p in order:
                if jump:
                    r = G.jumped(spec, first, *jump[p]) % G.U64(1000)
                else:
                    while at < p:
                        out, at = g.step(), at + 1
                    r = out % G.U64(1000)
                for s, v in wanted[p]:
                    hits[s] += r == v
            best = hits.argmax(axis=0)
            top = hits[best, np.arange(len(seed))]
            yield pd.DataFrame({"seed": seed, "matches": top.astype("int32"), "best_skip": np.where(top > 0, best + lo, 0).astype("int32")})

    return seeds.select("seed").mapInPandas(run, SCHEMA)


#: Presets of the hybrid sieve: name, misses in a row that end it, tolerance of the skip. Fixed values.
STRATEGIES = [
    ("strict_continuous", 3, 5),
    ("lenient_continuous", 10, 20),
    ("aggressive_reseed", 5, 5),
    ("balanced_hybrid", 7, 10),
    ("extreme_tolerance", 20, 50),
]


def hybrid(seeds: DataFrame, values: list[int], family: str, threshold: float, strategies: list[tuple[str, int, int]] | None = None, on_miss: str | None = None, reverse: bool = False) -> DataFrame:
    """Variable skips: at each value the skips around the expected one are tried in ascending order, and the first match is taken.

    ``on_miss``: what a seed's state is after a value that no skip matches, by default as the family has it. ``drift``: as many steps on
    as the greatest skip tried (the expected skip follows the last match); ``over``: one more; ``stay``: as before; ``step``: one step on, the expected skip stays 5 and the run
    ends only after more misses than allowed. The best strategy wins, the first of equals.
    """
    strategies, on_miss = strategies or STRATEGIES, on_miss or G.FAMILIES[family].on_miss
    values = [v % 1000 for v in (values[::-1] if reverse else values)]
    k, need = len(values), least_matches(threshold, len(values))
    schema = "seed bigint, matches int, total int, match_rate double, strategy_id int, strategy_name string, skip_pattern array<int>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, min(2_000, G.FAMILIES[family].batch)):
            seed = pdf["seed"].to_numpy()
            n = len(seed)
            best, which, pattern = np.zeros(n, int), np.zeros(n, int), np.full((n, k), -1)
            for sid, (_, most, tol) in enumerate(strategies):
                m, pat = _one_strategy(G.FAMILIES[family].for_hybrid()(seed), n, values, most, tol, on_miss)
                up = m > best
                best[up], which[up], pattern[up] = m[up], sid, pat[up]
            ok = np.flatnonzero(best >= need)
            yield pd.DataFrame(
                {
                    "seed": seed[ok], "matches": best[ok].astype("int32"), "total": np.int32(k), "match_rate": best[ok] / k, "strategy_id": which[ok].astype("int32"),
                    "strategy_name": pd.Series([strategies[i][0] for i in which[ok]], dtype=object), "skip_pattern": pd.Series([[int(x) for x in pattern[i] if x >= 0] for i in ok], dtype=object),
                }
            )

    return seeds.select("seed").mapInPandas(run, schema)


def _one_strategy(g: G.Stepper, n: int, values: list[int], most: int, tol: int, on_miss: str) -> tuple[np.ndarray, np.ndarray]:
    """Matches and skips of one strategy for a batch; seeds are grouped by their expected skip only through masks."""
    matches, missed, expect = np.zeros(n, int), np.zeros(n, int), np.full(n, 5)
    live, pat = np.ones(n, bool), np.full((n, len(values)), -1)
    for i, v in enumerate(values):
        if not live.any():
            break
        start = g.keep()
        lo, hi = np.maximum(expect - tol, 0), expect + tol
        found, skip = np.zeros(n, bool), expect.copy()
        after, after_hi, one = start, start, None
        for s in range(int(hi[live].max()) + 1):
            last = hi == s if on_miss in ("drift", "over") else None
            before = g.keep() if on_miss == "drift" and last.any() else None
            out = g.step() % G.U64(1000)
            if on_miss == "over" and last.any():
                before = g.keep()
            if s == 0 and on_miss == "step":
                one = g.keep()
            # the state after hi[seed] steps, before (or for "over" after) the output at skip hi
            if before is not None:
                after_hi = _blend(after_hi, before, last)
            hit = live & ~found & (s >= lo) & (s <= hi) & (out == v)
            if hit.any():
                after = _blend(after, g.keep(), hit)
                skip[hit], found = s, found | hit
        miss = live & ~found
        g.back(start)
        state = _blend(start, after, found)
        if on_miss in ("drift", "over"):
            state = _blend(state, after_hi, miss)
        elif on_miss == "step" and one is not None:
            state = _blend(state, one, miss)
        g.back(state)
        pat[live, i] = skip[live]
        matches += found
        if on_miss != "step":
            expect = np.where(found, skip, expect)
        missed = np.where(found, 0, missed + miss)
        live &= missed < most if on_miss != "step" else missed <= most
    return matches, pat


def _blend(a: tuple, b: tuple, where: np.ndarray) -> tuple:
    return tuple(np.where(where if x.ndim == 1 else where[:, None], y, x) if isinstance(x, np.ndarray) else y for x, y in zip(a, b))


def planted(family: str, seed: int, skips: list[int], hybrid: bool = False) -> list[int]:
    """Values that a seed gives with the given skips before each, as a sieve compares them."""
    spec, out = G.FAMILIES[family], []
    g = (spec.for_hybrid() if hybrid else spec.for_sieve())(np.array([seed], np.int64))
    for s in skips:
        for _ in range(s):
            g.step()
        out.append(int(g.step()[0] % G.U64(1000)))
    return out


def two_phase(seeds: DataFrame, values: list[int], family: str, skips: tuple[int, int], first: float = 0.2, second: float = 0.75, by_range: bool = False) -> DataFrame:
    """The cheap sieve's survivors, then the hybrid one on just these (or, with ``by_range``, on all seeds between the least and greatest)."""
    s1 = fixed_skip(seeds, values, family, skips, first).select("seed")
    if by_range:
        span = s1.agg(F.min("seed").alias("a"), F.max("seed").alias("b"))
        s1 = seeds.join(F.broadcast(span), F.col("seed").between(F.col("a"), F.col("b"))).select("seed")
    return hybrid(s1, values, family, second)


def digit_sequential(seeds: DataFrame, values: list[int], family: str, skips: tuple[int, int], least_digits: int = 2) -> DataFrame:
    """Three outputs per value, against its hundreds, tens and ones; best skip by partial, then full matches, the lowest on ties."""
    k, (lo, hi) = len(values), skips
    dig = [((v // 100) % 10, (v // 10) % 10, v % 10) for v in values]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, G.FAMILIES[family].batch):
            seed = pdf["seed"].to_numpy()
            best = np.full(len(seed), -1, np.int64)
            keep = [np.zeros(len(seed), np.int32) for _ in range(3)]
            for s in range(lo, hi + 1):
                g = G.FAMILIES[family].stepper(seed)
                full, part = np.zeros(len(seed), np.int32), np.zeros(len(seed), np.int32)
                for _ in range(s):
                    g.step()
                for d in dig:
                    n = sum((g.step() % G.U64(10) == x).astype(np.int32) for x in d)
                    full += n == 3
                    part += n >= least_digits
                    for _ in range(s):
                        g.step()
                rank = part.astype(np.int64) * (k + 1) + full
                up = rank > best
                best = np.where(up, rank, best)
                for a, b in zip(keep, (full, part, np.full(len(seed), s, np.int32))):
                    a[up] = b[up]
            yield pd.DataFrame({"seed": seed, "full_matches": keep[0], "partial_matches": keep[1], "best_skip": keep[2]})

    return seeds.select("seed").mapInPandas(run, "seed bigint, full_matches int, partial_matches int, best_skip int")


# ---- combining passes ------------------------------------------------------------------------------------------------


def bidirectional(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Seeds of both passes with both rates and their mean."""
    f = forward.select("seed", F.col("match_rate").alias("forward_match_rate"), F.col("best_skip").alias("forward_skip"))
    r = reverse.select("seed", F.col("match_rate").alias("reverse_match_rate"), F.col("best_skip").alias("reverse_skip"))
    return f.join(r, "seed").withColumn("score", (F.col("forward_match_rate") + F.col("reverse_match_rate")) / 2)


def trial_summary(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Counts and ratios of a trial, from one aggregate over the tagged union of both passes."""
    t = forward.select("seed", F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(reverse.select("seed", F.lit(0).alias("f"), F.lit(1).alias("r")))
    s = t.groupBy("seed").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    c = s.agg(*(F.coalesce(F.sum(e), F.lit(0)).cast("double").alias(n) for n, e in (("f", F.col("f")), ("r", F.col("r")), ("b", F.col("f") * F.col("r")))))
    f, r, b = F.col("f"), F.col("r"), F.col("b")
    one = F.lit(1.0)
    union = F.when((f == 0) | (r == 0), 0.0).otherwise(f + r - b)
    long = lambda x: x.cast("bigint")
    return c.select(
        long(f).alias("forward_count"), long(r).alias("reverse_count"), long(b).alias("bidirectional_count"), long(f - b).alias("forward_only_count"), long(r - b).alias("reverse_only_count"),
        F.when(union > 0, b / union).otherwise(0.0).alias("jaccard"), (b / F.greatest(union, one)).alias("intersection_ratio"), (b / F.greatest(f, one)).alias("survivor_overlap_ratio"),
        (f / F.greatest(r, one)).alias("bidirectional_selectivity"), (b / F.greatest(f + r, one)).alias("intersection_weight"),
        F.when(f > 0, b / f).otherwise(0.0).alias("precision"), F.when(r > 0, b / r).otherwise(0.0).alias("recall"),
    )


def accumulate(store: DataFrame, new: DataFrame, key: str = "seed", score: str = "score") -> DataFrame:
    """Upsert where the higher score wins and the stored row wins ties. A map-side combining aggregate, not a window."""
    cols = [c for c in store.columns if c != key]
    tag = lambda d, n: d.select(key, F.struct(F.col(score).alias("_s"), F.lit(n).alias("_o"), *cols).alias("_r"))
    both = tag(store, 1).unionByName(tag(new.select(*store.columns), 0))
    top = both.groupBy(key).agg(F.max("_r").alias("_r"))
    return top.select(key, *(F.col(f"_r.{c}").alias(c) for c in cols)).select(*store.columns)


def adaptive_threshold(seeds_from: int, seeds_to: int, values: list[int], family: str, spark: SparkSession, pilots: int = 128) -> DataFrame:
    """One row: pilots, mean, sd, phase1, phase2. Thresholds of the two phases from the match rates of evenly spaced pilot seeds at skip 0.

    phase1 is the mean and three standard deviations (two below 50 pilots), clamped; phase2 a quarter above it or 0.85 of the best
    pilot, whichever is more, clamped. Without pilots they are 0.15 and 0.7.
    """
    step = max(1, (seeds_to - seeds_from) // pilots)
    p = spark.range(seeds_from, min(seeds_to, seeds_from + pilots * step), step).withColumnRenamed("id", "seed")
    r = fixed_skip(p, values, family, (0, 0), 0.0).agg(F.count(F.lit(1)).alias("pilots"), F.avg("match_rate").alias("mean"), F.stddev_pop("match_rate").alias("sd"), F.max("match_rate").alias("_top"))
    clamp = lambda lo, hi, x: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    one = F.when(F.col("pilots") == 0, 0.15).when(F.col("pilots") < 50, clamp(0.001, 0.2, F.col("mean") + 2 * F.col("sd"))).otherwise(clamp(0.005, 0.25, F.col("mean") + 3 * F.col("sd")))
    r = r.withColumn("_one", one)
    best = F.when(F.col("_top") > F.col("_one"), F.col("_top") * 0.85).otherwise(F.col("_one") + 0.25)
    two = F.when(F.col("pilots") == 0, 0.7).otherwise(clamp(0.6, 0.9, F.greatest(F.col("_one") + 0.25, best)))
    return r.select("pilots", "mean", "sd", F.round("_one", 3).alias("phase1"), F.round(two, 3).alias("phase2"))


def hybrid_reverse(seeds: DataFrame, values: list[int], family: str, threshold: float, offset: int = 0, strategies: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Variable skips over the reversed values: skips 0..tolerance are tried, a miss leaves the state, more misses in a row than
    allowed reject a strategy, and the first strategy that reaches the threshold wins."""
    strategies = strategies or STRATEGIES
    values = [v % 1000 for v in values[::-1]]
    k, need = len(values), least_matches(threshold, len(values))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, min(2_000, G.FAMILIES[family].batch)):
            seed = pdf["seed"].to_numpy()
            n = len(seed)
            won, got = np.full(n, -1), np.zeros(n, int)
            for sid, (_, most, tol) in enumerate(strategies):
                g = G.FAMILIES[family].for_sieve()(seed)
                for _ in range(offset):
                    g.step()
                matches, missed, live = np.zeros(n, int), np.zeros(n, int), won < 0
                for v in values:
                    start = g.keep()
                    after, found = start, np.zeros(n, bool)
                    for _ in range(tol + 1):
                        hit = (g.step() % G.U64(1000) == v) & live & ~found
                        if hit.any():
                            after, found = _blend(after, g.keep(), hit), found | hit
                    g.back(_blend(start, after, found))
                    matches += found
                    missed = np.where(found, 0, missed + 1)
                    live &= missed <= most
                ok = live & (won < 0) & (matches >= need)
                won[ok], got[ok] = sid, matches[ok]
            at = np.flatnonzero(won >= 0)
            yield pd.DataFrame({"seed": seed[at], "matches": got[at].astype("int32"), "total": np.int32(k), "match_rate": got[at] / k, "strategy_id": won[at].astype("int32")})

    return seeds.select("seed").mapInPandas(run, "seed bigint, matches int, total int, match_rate double, strategy_id int")


def validate_survivors(seeds: DataFrame, values: list[int], family: str, skips: tuple[int, int]) -> DataFrame:
    """Each survivor's best skip by half its rate, .3 of its mean lane agreement and .2 of its longest run's share."""
    a, (lo, hi) = np.array([v % 1000 for v in values]), skips

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, min(20_000, G.FAMILIES[family].batch)):
            seed = pdf["seed"].to_numpy()
            best = np.full(len(seed), -1.0)
            out = {c: np.zeros(len(seed)) for c in ("rate", "lanes", "longest", "skip")}
            for s in range(lo, hi + 1):
                p = (G.sequences(family, seed, len(a), s, every=True) % G.U64(1000)).astype(np.int64)
                hit = p == a
                rate, lanes = hit.mean(1), ((p % 8 == a % 8).mean(1) + (p % 125 == a % 125).mean(1)) / 2
                run_, longest = np.zeros(len(seed)), np.zeros(len(seed))
                for i in range(len(a)):
                    run_ = np.where(hit[:, i], run_ + 1, 0)
                    longest = np.maximum(longest, run_)
                sc = 0.5 * rate + 0.3 * lanes + 0.2 * longest / len(a)
                up = sc > best
                best = np.where(up, sc, best)
                for c, v in (("rate", rate), ("lanes", lanes), ("longest", longest), ("skip", np.full(len(seed), s))):
                    out[c] = np.where(up, v, out[c])
            yield pd.DataFrame({"seed": seed, "score": best, "match_rate": out["rate"], "lane_agreement": out["lanes"], "longest_run": out["longest"].astype("int32"), "best_skip": out["skip"].astype("int32")})

    return seeds.select("seed").mapInPandas(run, "seed bigint, score double, match_rate double, lane_agreement double, longest_run int, best_skip int")


def predict_next(survivors: DataFrame, family: str, position: int, weight: str = "score") -> DataFrame:
    """Each survivor's output at a position, as a number to vote for with its weight."""
    return G.with_sequence(survivors, family, "seed", position, name="_o", mod=1000).select("seed", F.element_at("_o", position).alias("number"), F.col(weight).alias("weight"))
