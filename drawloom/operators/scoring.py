"""What is put beside survivors: metadata, features of the whole series, hits on held-out values; and regimes of the series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.operators import generators as G
from drawloom.operators import windows as W

#: Counts and ratios of a trial that its survivors carry. Fixed names.
METADATA = [
    "forward_count", "reverse_count", "bidirectional_count", "intersection_count", "intersection_ratio", "survivor_overlap_ratio",
    "skip_min", "skip_max", "skip_range", "skip_mean", "skip_std", "skip_entropy", "bidirectional_selectivity", "survivor_velocity",
    "velocity_acceleration", "intersection_weight", "forward_only_count", "reverse_only_count",
]
#: Columns of the row of global features. Fixed names.
GLOBAL = [
    "frequency_bias_ratio", "high_variance_count", "marker_390_variance", "marker_575_variance", "marker_804_variance", "power_of_two_bias", "regime_age",
    "regime_change_detected", "reseed_probability", "residue_1000_entropy", "residue_125_entropy", "residue_8_entropy", "suspicious_gap_percentage", "temporal_stability",
]


def with_metadata(seeds: DataFrame, meta: DataFrame, fields: list[str], on: str = "seed", default: float = 0.0) -> DataFrame:
    """Every seed with the fields of its metadata as doubles; fields that are null, seeds without metadata and columns that ``meta`` lacks give the default."""
    have = meta.select(on, *(F.col(f).cast("double").alias(f"_m_{f}") for f in fields if f in meta.columns))
    cols = [F.coalesce(F.col(f"_m_{f}") if f in meta.columns else F.lit(None).cast("double"), F.lit(default)).alias(f) for f in fields]
    return seeds.join(have, on, "left").select(*(c for c in seeds.columns if c not in fields), *cols)


def with_global(df: DataFrame, row: DataFrame, prefix: str = "global_") -> DataFrame:
    """Every row with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(row.limit(1).select(*(F.col(c).alias(prefix + c) for c in row.columns))))


def global_state(series: DataFrame, value: str = "draw", order: str = "idx", window: int = 1000, gap: int = 500, change: float = 0.15, markers: tuple[int, ...] = (390, 575, 804)) -> DataFrame:
    """One row with the columns of GLOBAL over values 0..999. A series of fewer than 100 values gives the defaults.

    All but the markers' gaps and the trailing windows come from one combining aggregate per value, at most 1,000 rows. A series'
    positions are counted in blocks.
    """
    x = W.row_index(series.select(F.col(order).alias("idx"), F.col(value).cast("bigint").alias("v")), "pos")
    n = x.agg(F.count(F.lit(1)).alias("n"))
    x = x.crossJoin(F.broadcast(n))
    back = F.col("n") - 1 - F.col("pos")
    per = x.groupBy("v").agg(
        F.count(F.lit(1)).alias("c"), F.min(back).alias("ago"), F.max("n").alias("n"),
        F.sum((back < window).cast("int")).alias("new"), F.sum(((back >= window) & (back < 2 * window)).cast("int")).alias("old"),
    )
    p, q = (F.col("new") + 1) / (window + 1000), (F.col("old") + 1) / (window + 1000)
    # values that neither window has give nothing; those of one only are there
    one = per.agg(
        F.max("n").alias("n"), (F.max("c") / F.min("c")).alias("frequency_bias_ratio"),
        (F.sum(F.when(F.col("v").isin([1 << i for i in range(10)]), F.col("c")).otherwise(0)) / F.max("n") / (10 / 1000)).alias("power_of_two_bias"),
        ((1000 - F.count(F.lit(1)) + F.sum((F.col("ago") > gap).cast("int"))) / 1000).alias("suspicious_gap_percentage"), F.sum(p * F.ln(p / q)).alias("kl"),
    )
    for m in (8, 125, 1000):
        r = per.groupBy((F.col("v") % m).alias("r")).agg((F.sum("c") / F.max("n") + 1e-10).alias("p"))
        s, e = 1 + m * 1e-10, 1e-10
        term = lambda y: -(y / s) * F.ln(y / s)  # noqa: E731, B023
        one = one.crossJoin(r.agg(((F.sum(term(F.col("p"))) + (m - F.count(F.lit(1))) * term(F.lit(e))) / np.log(m)).alias(f"residue_{m}_entropy")))
    for m in markers:
        g = W.lagged(W.row_index(x.where(F.col("v") == m).select("pos"), "k", "pos"), "pos", [1], "k").select((F.col("pos") - F.col("pos_lag1")).alias("g"))
        one = one.crossJoin(g.agg(F.coalesce(F.stddev_pop("g") / F.avg("g"), F.lit(0.0)).alias(f"marker_{m}_variance")))
    size = F.least(F.lit(100), F.floor(F.col("n") / 4))
    last = x.where(back < 4 * size).select(F.floor(back / size).alias("w"), "v").distinct()
    both = last.join(last.select((F.col("w") - 1).alias("w"), "v"), ["w", "v"]).agg((F.count(F.lit(1)) / 3 / 1000).alias("stable"))
    one = one.crossJoin(both)
    high = sum((F.col(f"marker_{m}_variance") > 1).cast("int") for m in markers).cast("double")
    two, changed = F.col("n") >= 2 * window, F.col("kl") > change
    out = {c: F.col(c) for c in GLOBAL if c not in ("high_variance_count", "reseed_probability", "regime_change_detected", "regime_age", "temporal_stability")}
    out |= {"high_variance_count": high, "reseed_probability": high / len(markers), "temporal_stability": F.col("stable")}
    out |= {"regime_change_detected": F.when(two & changed, 1.0).otherwise(0.0), "regime_age": F.when(two & ~changed, F.col("n").cast("double")).otherwise(0.0)}
    default = {"frequency_bias_ratio": 1.0, "temporal_stability": 1.0}
    return one.select(*(F.when(F.col("n") >= 100, out[c]).otherwise(default.get(c, 0.0)).alias(c) for c in GLOBAL))


def holdout_hits(seeds: DataFrame, held_out: list[int], family: str, train: int, mod: int = 1000) -> DataFrame:
    """seed, holdout_hits: the share of held-out values that the seed's outputs after ``train`` ones hit; 0 without any. A map over seeds."""
    a = np.array([v % mod for v in held_out], np.int64)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, G.FAMILIES[family].batch):
            s = pdf["seed"].to_numpy()
            p = (G.sequences(family, s, len(a), train) % G.U64(mod)).astype(np.int64) if len(a) else np.zeros((len(s), 0), np.int64)
            yield pd.DataFrame({"seed": s, "holdout_hits": (p == a).mean(1) if len(a) else np.zeros(len(s))})

    return seeds.select("seed").mapInPandas(run, "seed bigint, holdout_hits double")


# ---- regimes ---------------------------------------------------------------------------------------------------------


def density(series: DataFrame, sizes: list[int], value: str = "draw", order: str = "idx", windows: int = 20) -> DataFrame:
    """size, density: how far residues in evenly spaced windows are from uniform, squashed to 0..1; 0 for a series shorter than two windows.

    The windows' positions, a parameter's worth, are broadcast, so the series is read once and nothing else is shuffled.
    """
    spark = series.sparkSession
    n = series.agg(F.max(order).alias("n")).select((F.coalesce("n", F.lit(-1)) + 1).alias("n"))
    w = spark.createDataFrame([(s, i, j) for s in sizes for i in range(windows) for j in range(s)], "size int, win int, at int")
    step = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("size")) / windows))
    w = w.crossJoin(F.broadcast(n)).withColumn("_s", F.col("win") * step).where((F.col("n") >= 2 * F.col("size")) & (F.col("_s") < F.col("n") - F.col("size")))
    x = series.select(F.col(order).alias("_i"), F.col(value).alias("_v")).join(F.broadcast(w.select("size", "win", (F.col("_s") + F.col("at")).alias("_i"))), "_i")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col("_v") % m).alias("r")) for m in (8, 125))))
    chi = residue_chi(x.select("size", "win", each.alias("e")).select("size", "win", "e.m", "e.r"), ["size", "win"])
    return squashed(chi, spark.createDataFrame([(s,) for s in sizes], "size int"), ["size"])


def residue_chi(x: DataFrame, by: list[str]) -> DataFrame:
    """by..., chi: chi-square modulo 8, and a tenth of that modulo 125 in windows of at least 50."""
    c = x.groupBy(*by, "m", "r").agg(F.count(F.lit(1)).alias("c"))
    chi = c.groupBy(*by, "m").agg((F.max("m") * F.sum(F.col("c") * F.col("c")) / F.sum("c") - F.sum("c")).alias("x"))
    return chi.groupBy(*by).agg(F.sum(F.when(F.col("m") == 8, F.col("x")).when(F.col("size") >= 50, F.col("x") * 0.1).otherwise(0.0)).alias("chi"))


def squashed(chi: DataFrame, every: DataFrame, by: list[str]) -> DataFrame:
    d = chi.groupBy(*by).agg(F.round(F.tanh(F.avg("chi") / (F.max("size") * 2.0)), 4).alias("density"))
    return every.join(F.broadcast(d), by, "left").select(*by, F.coalesce("density", F.lit(0.0)).alias("density"))


#: Shares of the greatest density above which, or below which, a window counts as high, middling or low. Fixed values.
HIGH, MIDDLE, LOW = 0.35, 0.20, 0.22


def regime_type(series: DataFrame, value: str = "draw", order: str = "idx") -> DataFrame:
    """One row: densities of windows of 3, 8, 31 and 64, their duality, the regime's type and its confidence."""
    d = density(series, [3, 8, 31, 64], value, order).agg(*(F.max(F.when(F.col("size") == s, F.col("density"))).alias(f"w{s}") for s in (3, 8, 31, 64)))
    top = F.greatest("w3", "w8", "w31", "w64", F.lit(1e-9))
    n3, n8, n31, n64 = (F.col(f"w{s}") / top for s in (3, 8, 31, 64))
    dual = F.round(F.least(n3, n8) - F.greatest(n31, n64), 4)
    kind = (
        F.when((n3 > HIGH) & (n8 > HIGH) & (n31 < LOW) & (n64 < LOW), "short_persistence")
        .when((n31 > MIDDLE) | (n64 > MIDDLE), "long_persistence")
        .otherwise("unknown")
    )
    return d.select("w3", "w8", "w31", "w64", dual.alias("duality"), F.round(F.col("w3") / (F.col("w8") + 1e-9), 4).alias("ratio"), kind.alias("regime_type"), F.round(1 / (1 + F.exp(-dual * 6)), 4).alias("confidence"))


def skip_entropy(series: DataFrame, value: str = "draw", order: str = "idx", known: tuple[int, int] = (5, 56)) -> DataFrame:
    """One row about the distances of neighbours modulo 1000: entropy, mean, spread, 5th and 95th percentile, and whether these meet the known range. Zeros below ten values."""
    g = W.lagged(series.select(order, value), value, [1], order).where(f"{value}_lag1 IS NOT NULL").groupBy((F.abs(F.col(value) - F.col(f"{value}_lag1")) % 1000).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    c, v = F.col("c"), F.col("g")
    n, mean = F.sum("c"), F.sum(c * v) / F.sum("c")
    # at most 1,000 distances with their counts
    a = g.agg(
        n.alias("n"), (F.log2(n) - F.sum(c * F.log2(c)) / n).alias("h"), mean.alias("mean"), F.sqrt(F.sum(c * v * v) / n - mean * mean).alias("sd"),
        F.percentile("g", F.lit(0.05), F.col("c")).alias("p5"), F.percentile("g", F.lit(0.95), F.col("c")).alias("p95"),
    )
    ok = F.coalesce(F.col("n") >= 9, F.lit(False))
    lo, hi = F.col("p5").cast("int"), F.col("p95").cast("int")
    out = lambda e, z: F.when(ok, e).otherwise(z)
    return a.select(
        out(F.round("h", 6), 0.0).alias("entropy"), out(F.round("mean", 3), 0.0).alias("mean"), out(F.round("sd", 3), 0.0).alias("sd"), out(lo, 0).alias("lo"), out(hi, 0).alias("hi"),
        (ok & (lo <= known[1]) & (hi >= known[0])).alias("consistent"),
    )


def shuffle_test(series: DataFrame, size: int, trials: int = 20, value: str = "draw", order: str = "idx", windows: int = 20) -> DataFrame:
    """One row: the density against that of shuffled series, as a ratio and in standard deviations, with a verdict.

    A shuffled series is looked at in ``windows`` windows only, which are a sample without order; so each trial takes the values
    with the lowest keyed hashes, a top-k of fixed size, instead of sorting the series.
    """
    spark = series.sparkSession
    real = density(series, [size], value, order, windows).select(F.col("density").alias("real"))
    k = windows * size
    trial = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("trial").cast("string"), F.col("_i").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    x = series.select(F.col(order).alias("_i"), F.col(value).alias("_v")).crossJoin(F.broadcast(trial)).withColumn("_h", h)
    from pyspark.sql import Window

    top = x.withColumn("_r", F.row_number().over(Window.partitionBy("trial").orderBy("_h", "_i"))).where(F.col("_r") <= k)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col("_v") % m).alias("r")) for m in (8, 125))))
    y = top.select("trial", F.lit(size).alias("size"), F.floor((F.col("_r") - 1) / size).alias("win"), each.alias("e")).select("trial", "size", "win", "e.m", "e.r")
    d = squashed(residue_chi(y, ["trial", "size", "win"]), trial, ["trial"])
    s = d.agg(F.avg("density").alias("mean"), F.stddev_pop("density").alias("sd")).crossJoin(real)
    ratio, z = F.col("real") / (F.col("mean") + 1e-9), (F.col("real") - F.col("mean")) / (F.col("sd") + 1e-9)
    verdict = F.when((ratio > 2) & (z > 3), "real").when((ratio > 1.3) & (z > 1.5), "weak").otherwise("artifact")
    return s.select(F.lit(size).alias("size"), "real", F.round("mean", 4).alias("shuffled_mean"), F.round("sd", 4).alias("shuffled_sd"), F.round(ratio, 3).alias("ratio"), F.round(z, 2).alias("z"), verdict.alias("verdict"))


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Each cluster of ``b`` (regime and centroid columns ``on``) with the nearest cluster of ``a``: regime, same_as, distance. Two handfuls of clusters."""
    d = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in on))
    pairs = b.alias("b").crossJoin(F.broadcast(a.alias("a"))).select(F.col("b.regime").alias("regime"), F.struct(d.alias("distance"), F.col("a.regime").alias("same_as")).alias("m"))
    return pairs.groupBy("regime").agg(F.min("m").alias("m")).select("regime", "m.same_as", "m.distance")


def fuse(scales: DataFrame, primary: str, second: str, age: Column | int, most: float = 0.15) -> DataFrame:
    """One row of several scales (scale, weight, regime, silhouette, stable), regimes aligned before: the primary regime, whether it is
    stable at the second scale too, and the confidence: the weighted silhouette of the scales that agree, squashed, and a boost for age."""
    at = lambda s, c: F.max(F.when(F.col("scale") == s, F.col(c)))
    p = scales.agg(at(primary, "regime").alias("_p"), at(second, "regime").alias("_q"), at(primary, "stable").alias("_ok"))
    x = scales.crossJoin(F.broadcast(p)).where("regime = _p")
    s = x.groupBy("_p", "_q", "_ok").agg((F.sum(F.col("weight") * F.col("silhouette")) / F.sum("weight")).alias("s"))
    boost = F.least(F.lit(most), F.lit(age) * 0.02)
    return s.select(F.col("_p").alias("regime"), ((F.col("_p") == F.col("_q")) & F.col("_ok")).alias("stable"), F.round(F.least(F.lit(1.0), F.tanh(F.col("s") * 10) + boost), 4).alias("confidence"))
