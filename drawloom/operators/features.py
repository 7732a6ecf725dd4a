"""Per-seed feature rows, signal features and regimes.

A seed's predictions and the history are held against each other inside one Arrow batch of seeds: all statistics are matrix
operations over (seeds, positions), so that a seed's row needs no shuffle. The history is a window's worth of values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawloom.operators import generators as G
from drawloom.operators import windows as W

MODS = (8, 125, 1000)


def _names() -> list[str]:
    n = ["score", "confidence", "exact_matches", "total_predictions"]
    n += [f"{x}_{m}" for m in MODS for x in ("match_rate", "coherence", "kl")]
    n += [f"temporal_stability_{x}" for x in ("mean", "std", "min", "max", "trend")]
    n += [f"{s}_{x}" for s in ("pred", "actual") for x in ("mean", "std", "min", "max")]
    n += ["residual_mean", "residual_std", "residual_abs_mean", "residual_max_abs", "lane_agreement_8", "lane_agreement_125", "lane_consistency"]
    n += ["hundreds_agreement", "tens_agreement", "ones_agreement", "expected_digit_matches"]
    n += [f"fft_{x}" for x in ("peak", "second", "concentration", "diff_peak", "diff_concentration")]
    n += [f"autocorr_{i}" for i in range(1, 11)] + ["autocorr_mean_abs", "autocorr_trend", "cusum_max", "cusum_mean", "zero_crossings", "popcount_mean", "popcount_std", "popcount_bias"]
    return n


FEATURES = _names()


def seed_features(seeds: DataFrame, history: list[int], family: str, skip: int = 0, windows: int = 5) -> DataFrame:
    """seed and the columns of FEATURES. Spreads are sample spreads; divergences are not renormalised."""
    a = np.array([v % 1000 for v in history], np.int64)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in G.batches(it, 2_000):
            raw = G.sequences(family, pdf["seed"].to_numpy(), len(a), skip)
            f = feature_matrix((raw % G.U64(1000)).astype(np.int64), a, raw, windows)
            yield pd.DataFrame({"seed": pdf["seed"].to_numpy(), **f})

    return seeds.select("seed").mapInPandas(run, "seed bigint, " + ", ".join(f"{n} double" for n in FEATURES))


def feature_matrix(p: np.ndarray, a: np.ndarray, raw: np.ndarray, windows: int) -> dict[str, np.ndarray]:
    """All features of predictions p (seeds, n) against values a (n)."""
    n = p.shape[1]
    hit = p == a
    rate = hit.mean(1)
    f = {"score": 100 * rate, "confidence": np.maximum(rate, 0.1), "exact_matches": hit.sum(1).astype(float), "total_predictions": np.full(len(p), float(n))}
    for m in MODS:
        hp = _hist(p % m, m) / n
        ha = np.bincount(a % m, minlength=m) / n
        x, y = np.maximum(hp, 1e-10), np.maximum(ha, 1e-10)
        kl = (x * np.log(x / y)).sum(1)
        f |= {f"match_rate_{m}": (p % m == a % m).mean(1), f"kl_{m}": kl, f"coherence_{m}": 1 / (1 + kl)}
    width = max(1, n // max(1, windows))
    w = np.stack([hit[:, i * width : (i + 1) * width].mean(1) for i in range(max(1, n // width)) if (i + 1) * width <= n], 1)
    x = np.arange(w.shape[1]) - (w.shape[1] - 1) / 2
    f |= {"temporal_stability_mean": w.mean(1), "temporal_stability_std": w.std(1, ddof=1) if w.shape[1] > 1 else np.zeros(len(p)), "temporal_stability_min": w.min(1), "temporal_stability_max": w.max(1), "temporal_stability_trend": (w * x).sum(1) / max((x * x).sum(), 1e-12)}
    sd = lambda v: v.std(-1, ddof=1) if n > 1 else np.zeros(v.shape[:-1])
    for k, v in (("pred", p), ("actual", np.broadcast_to(a, p.shape))):
        f |= {f"{k}_mean": v.mean(1), f"{k}_std": sd(v), f"{k}_min": v.min(1).astype(float), f"{k}_max": v.max(1).astype(float)}
    r = p - a
    f |= {"residual_mean": r.mean(1), "residual_std": sd(r), "residual_abs_mean": np.abs(r).mean(1), "residual_max_abs": np.abs(r).max(1).astype(float)}
    f |= {"lane_agreement_8": f["match_rate_8"], "lane_agreement_125": f["match_rate_125"], "lane_consistency": (f["match_rate_8"] + f["match_rate_125"]) / 2}
    d = [(p // q % 10 == a // q % 10).mean(1) for q in (100, 10, 1)]
    f |= {"hundreds_agreement": d[0], "tens_agreement": d[1], "ones_agreement": d[2], "expected_digit_matches": sum(d)}
    return f | battery(p, raw)


def _hist(r: np.ndarray, m: int) -> np.ndarray:
    return np.bincount((r + np.arange(len(r))[:, None] * m).ravel(), minlength=len(r) * m).reshape(len(r), m)


def battery(p: np.ndarray, raw: np.ndarray) -> dict[str, np.ndarray]:
    """Spectrum, autocorrelation, cumulative sums and bit counts of each row; zeros below eight values."""
    k, n = p.shape
    z = np.zeros(k)
    names = [x for x in FEATURES if x.startswith(("fft", "autocorr", "cusum", "zero", "popcount"))]
    if n < 8:
        return {x: z for x in names}
    c = p - p.mean(1, keepdims=True)
    out = {}
    for tag, s in (("", c), ("diff_", np.diff(c, axis=1))):
        mag = np.sort(np.abs(np.fft.rfft(s, axis=1))[:, 1:], axis=1)[:, ::-1]
        out |= {f"fft_{tag}peak": mag[:, 0], f"fft_{tag}second": mag[:, 1], f"fft_{tag}concentration": mag[:, 0] / np.maximum(mag.sum(1), 1e-12)}
    out.pop("fft_diff_second")
    ss = (c * c).sum(1)
    ac = [np.where(ss > 1e-12, (c[:, i:] * c[:, :-i]).sum(1) / np.maximum(ss, 1e-12), 0.0) if n > 10 else z for i in range(1, 11)]
    out |= {f"autocorr_{i + 1}": v for i, v in enumerate(ac)}
    m = np.abs(np.stack(ac, 1))
    x = np.arange(10) - 4.5
    out |= {"autocorr_mean_abs": m.mean(1), "autocorr_trend": (m * x).sum(1) / (x * x).sum()}
    cs = np.cumsum(c, 1)
    sg = np.sign(np.where(np.abs(cs) < 1e-9, 0, cs))
    cross = [int((np.diff(row[row != 0]) != 0).sum()) for row in sg]
    out |= {"cusum_max": np.abs(cs).max(1), "cusum_mean": np.abs(cs).mean(1), "zero_crossings": np.array(cross, float)}
    bits = np.bitwise_count(raw & G.M32).astype(float)
    return out | {"popcount_mean": bits.mean(1), "popcount_std": bits.std(1, ddof=1), "popcount_bias": bits.mean(1) - 16}


def dominant_period(series: DataFrame, value: str, order: str, lags: tuple[int, int] = (10, 200), block: int = 8192) -> DataFrame:
    """The strongest period within the lags, by the power spectrum of blocks of the series, averaged over blocks (Welch's way): no task holds the series."""
    schema = "freq int, power double"

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(block)
        v = pdf.sort_values(order)[value].to_numpy(float)
        x[: len(v)] = v - v.mean()
        s = np.abs(np.fft.rfft(x)) ** 2
        return pd.DataFrame({"freq": np.arange(len(s), dtype=np.int32), "power": s})

    x = series.select(order, value).withColumn("_b", F.floor(F.col(order) / block))
    p = x.groupBy("_b").applyInPandas(spectrum, schema).where("freq > 0").groupBy("freq").agg(F.avg("power").alias("power"))
    lag = F.lit(block) / F.col("freq")
    inside = p.where(lag.between(*lags))
    t = inside.agg(F.sum("power").alias("_t"))
    return inside.crossJoin(F.broadcast(t)).orderBy(F.desc("power"), "freq").limit(1).select(F.round(lag).cast("int").alias("period"), (F.col("power") / F.col("_t")).alias("share")).withColumn("confident", F.col("share") > 0.15)


def regime_windows(series: DataFrame, value: str, size: int, stride: int, order: str = "idx", digits: bool = False) -> DataFrame:
    """Per sliding window: entropies modulo 8, 125 and 1000 and the shares of the 64 transitions modulo 8, or with ``digits`` the row
    shares of the 300 transitions of hundreds, tens and ones."""
    d = W.lagged(series.select(order, value), value, [1], order)
    x = W.sliding(d, size, stride, order=order)
    res = x.select("win", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col(value) % m).alias("r")) for m in MODS))).alias("e")).groupBy("win", "e.m", "e.r").agg(F.count(F.lit(1)).alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    ent = res.groupBy("win", "m").agg(h.alias("h")).groupBy("win").pivot("m", list(MODS)).agg(F.first("h"))
    ent = ent.toDF("win", *(f"entropy_{m}" for m in MODS))
    if digits:
        last, now = F.col(f"{value}_lag1"), F.col(value)
        cell = [(j * 100 + F.floor(last / q) % 10 * 10 + F.floor(now / q) % 10).cast("int") for j, q in enumerate((100, 10, 1))]
        c = x.where(f"{value}_lag1 IS NOT NULL").select("win", F.explode(F.array(*cell)).alias("c")).groupBy("win", "c").agg(F.count(F.lit(1)).alias("n"))
        rows = c.groupBy("win", F.floor(F.col("c") / 10).alias("r")).agg(F.collect_list(F.struct("c", "n")).alias("a"), F.sum("n").alias("t"))
        rows = rows.select("win", F.explode("a").alias("e"), "t").groupBy("win").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.c").alias("c"), (F.col("e.n") / F.col("t")).alias("p")))).alias("mp"))
        return ent.join(rows, "win").select("win", *(f"entropy_{m}" for m in MODS), F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.coalesce(F.element_at("mp", i), F.lit(0.0))).alias("transitions"))
    t = x.where(f"{value}_lag1 IS NOT NULL").groupBy("win", ((F.col(f"{value}_lag1") % 8) * 8 + F.col(value) % 8).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    tr = t.groupBy("win").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), (F.col("n") / size).alias("p")))).alias("mp"))
    return ent.join(tr, "win").select("win", *(f"entropy_{m}" for m in MODS), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("mp", i), F.lit(0.0))).alias("transitions"))


def regimes(windows: DataFrame, k: int = 5, seed: int = 1, quality: bool = False) -> DataFrame:
    """Windows in k clusters of standardised features; clusters are numbered by their mean entropy, so that the numbers mean the same
    everywhere. With ``quality`` also the silhouette of the clustering, the same in each row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector

    d = windows.withColumn("_t", array_to_vector("transitions"))
    d = VectorAssembler(inputCols=[*(f"entropy_{m}" for m in MODS), "_t"], outputCol="_raw").transform(d)
    d = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(d).transform(d)
    c = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_c").fit(d).transform(d).select("win", "entropy_1000", "_c", "_x")
    order = c.groupBy("_c").agg(F.avg("entropy_1000").alias("e")).withColumn("regime", F.row_number().over(Window.orderBy("e", "_c")) - 1)  # k rows
    out = c.join(F.broadcast(order), "_c").select("win", "regime")
    if quality:
        several = c.select("_c").distinct().count() > 1
        s = ClusteringEvaluator(featuresCol="_x", predictionCol="_c").evaluate(c) if several else 0.0
        out = out.withColumn("silhouette", F.lit(float(s)))
    return out


def train_and_score(df: DataFrame, features: list[str], label: str, model: str = "gbt", folds: int = 3, seed: int = 42) -> DataFrame:
    """Mean R2 over hash folds of a tree ensemble, a forest or a linear model."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    est = {"gbt": GBTRegressor(labelCol=label, maxIter=10, maxDepth=3, seed=seed), "forest": RandomForestRegressor(labelCol=label, numTrees=20, seed=seed), "linear": LinearRegression(labelCol=label)}[model]
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    d = d.withColumn("_f", F.pmod(F.xxhash64(*features), F.lit(folds))).select("features", label, "_f").persist()
    ev = RegressionEvaluator(labelCol=label, metricName="r2")
    r2 = [ev.evaluate(est.fit(d.where(F.col("_f") != i)).transform(d.where(F.col("_f") == i))) for i in range(folds)]
    n = d.count()
    d.unpersist()
    return df.sparkSession.createDataFrame([(model, n, float(np.mean(r2)), float(np.std(r2)))], "model string, n bigint, r2_mean double, r2_sd double")


def permutation_importance(df: DataFrame, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """How much R2 falls when a feature is shuffled; shuffled by ranks of a hash, joined back, so that no task sees the whole column."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    df = df.select(label, *features).na.drop()
    m = LinearRegression(labelCol=label).fit(va.transform(df))
    ev = RegressionEvaluator(labelCol=label, metricName="r2")
    base = ev.evaluate(m.transform(va.transform(df)))
    rows = W.row_index(df.withColumn("_h", F.pmod(F.xxhash64(*features, label), F.lit(1 << 40))), "_i", "_h", 1 << 34)
    n = rows.count()
    out = []
    for f in features:
        moved = rows.select(((F.col("_i") + max(1, n // 3)) % n).alias("_i"), F.col(f).alias("_m"))
        x = rows.join(moved, "_i").drop(f).withColumnRenamed("_m", f)
        out.append((f, base - ev.evaluate(m.transform(va.transform(x)))))
    return df.sparkSession.createDataFrame(out, "feature string, importance double")


def choose(scores: DataFrame, model: str, score: str, lower_is_better: bool = False) -> DataFrame:
    """The row of the best score, of equals the first by name."""
    return scores.orderBy(F.asc(score) if lower_is_better else F.desc_nulls_last(score), model).limit(1)


def single_fits(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """model, r2 of a linear model of each feature alone: one aggregate, as R2 is a squared correlation there."""
    y = F.col(label).cast("double")
    row = df.agg(*(F.corr(F.col(f).cast("double"), y).alias(f) for f in features))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("model"), F.coalesce(F.col(f) * F.col(f), F.lit(0.0)).alias("r2")) for f in features)))
    return row.select(each.alias("e")).select("e.*")


def _linear_r2(train: DataFrame, test: DataFrame, features: list[str], label: str) -> float:
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    m = LinearRegression(featuresCol="_f", labelCol=label).fit(va.transform(train))
    return RegressionEvaluator(labelCol=label, metricName="r2").evaluate(m.transform(va.transform(test)))


def shuffled_label_test(df: DataFrame, features: list[str], label: str, ident: list[str], most: float = 0.1, drop: float = 0.5) -> DataFrame:
    """One row: R2 on held-out rows with true and with shuffled training labels, and whether the second collapses (passed).

    Labels are shuffled by moving them along an order by hash, counted in blocks, so no task holds the column. A fifth of the rows,
    by another hash, is held out.
    """
    d = df.select(*ident, label, *features).na.drop().withColumn("_u", F.pmod(F.xxhash64(F.lit("split"), *ident), F.lit(5)))
    train, test = d.where("_u > 0"), d.where("_u = 0")
    rows = W.row_index(train.withColumn("_h", F.pmod(F.xxhash64(*ident), F.lit(1 << 40))), "_i", "_h", 1 << 34)
    n = rows.count()
    moved = rows.select(F.pmod(F.col("_i") + max(1, n // 3), F.lit(max(1, n))).alias("_i"), F.col(label).alias("_m"))
    shuffled = rows.drop(label).join(moved, "_i").withColumnRenamed("_m", label)
    a, b = _linear_r2(train, test, features, label), _linear_r2(shuffled, test, features, label)
    return df.sparkSession.createDataFrame([(a, b, b < most and a - b > drop)], "real_r2 double, shuffled_r2 double, passed boolean")


def ablation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, loss: how much R2 a linear model loses when it is fitted without the feature."""
    d = df.select(label, *features).na.drop()
    base = _linear_r2(d, d, features, label)
    out = [(f, base - _linear_r2(d, d, [x for x in features if x != f], label)) for f in features]
    return df.sparkSession.createDataFrame(out, "feature string, loss double")


def attribution(df: DataFrame, weights: dict[str, float], ident: list[str], digits: int | None = None) -> DataFrame:
    """ident... and, per feature of a linear model, its share of the row's attribution, |weight x value|; shares add up to 1 unless all are 0."""
    part = {f: F.abs(F.col(f).cast("double") * w) for f, w in weights.items()}
    total = F.greatest(sum(part.values()), F.lit(1e-12))
    out = lambda c: F.round(c, digits) if digits is not None else c
    return df.select(*ident, *(out(c / total).alias(f) for f, c in part.items()))


def reconstruct_lcg(values: list[int], m: int) -> tuple[int, int] | None:
    """a and c of x' = a x + c mod m from outputs in a row, if the differences allow; None otherwise."""
    for i in range(len(values) - 2):
        d = (values[i + 1] - values[i]) % m
        try:
            inv = pow(d, -1, m)
        except ValueError:
            continue
        a = (values[i + 2] - values[i + 1]) * inv % m
        c = (values[i + 1] - a * values[i]) % m
        if all((a * x + c) % m == y for x, y in zip(values, values[1:])):
            return a, c
    return None


def reconstruct(df: DataFrame, by: str, order: str, value: str, m: int) -> DataFrame:
    """Congruential parameters per group of outputs, where three in a row and the rest agree; the next output too."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = [int(x) for x in pdf.sort_values(order)[value]]
        r = reconstruct_lcg(v, m) if len(v) >= 3 else None
        return pd.DataFrame({by: [pdf[by].iloc[0]], "found": [r is not None], "a": [r[0] if r else None], "c": [r[1] if r else None], "next": [(r[0] * v[-1] + r[1]) % m if r else None]}).astype({"a": "Int64", "c": "Int64", "next": "Int64"})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, value).groupBy(by).applyInPandas(one, f"{by} {kind}, found boolean, a bigint, c bigint, next bigint")
