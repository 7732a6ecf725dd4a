"""Pools of predictions, their evaluation and back-tests, drift and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.storage import written


def weighted_pool(df: DataFrame, number: str, weight: Column, sizes: list[int]) -> DataFrame:
    """The heaviest numbers (ties by the number) with rank and, per pool size, whether they are in. Numbers are few; votes are combined map-side."""
    v = df.groupBy(F.col(number).alias("number")).agg(F.sum(weight).alias("weight"))
    top = v.orderBy(F.desc("weight"), "number").limit(max(sizes))
    w = Window.orderBy(F.desc("weight"), "number")  # at most the largest pool
    return top.withColumn("rank_no", F.row_number().over(w))


def coverage(df: DataFrame, number: str, weight: Column, sizes: list[int]) -> DataFrame:
    """Share of all weight that each pool holds."""
    t = df.agg(F.sum(weight).alias("total"))
    p = weighted_pool(df, number, weight, sizes).crossJoin(F.broadcast(t))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("pool"), F.when(F.col("rank_no") <= s, F.col("weight")).otherwise(0.0).alias("w")) for s in sizes)))
    return p.select(each.alias("e"), "total").groupBy("e.pool").agg(F.round(F.sum("e.w") / F.max("total"), 3).alias("coverage"))


def trailing_history(targets: DataFrame, history: DataFrame, w: int, by: str = "session", at: str = "date") -> DataFrame:
    """For each target the last w rows of the same session before its date: an as-of window.

    A row's rank in its session is the number of rows of earlier dates, from one row per session and date, and its place within the
    date; so no window holds a session's rows. History and targets join on (session, rank), each target with the w ranks below its
    own, and nothing is compared that isn't wanted.
    """
    days = history.groupBy(by, at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    asked = targets.select(by, at).distinct().withColumn("_n", F.lit(0).cast("bigint")).withColumn("_k", F.lit(0))
    # a target comes before the rows of its own date; one row per session and date
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = days.unionByName(asked).withColumn("_r", before)
    first = u.where("_k = 1").select(by, at, F.col("_r").alias("_first"))
    within = F.row_number().over(Window.partitionBy(by, at).orderBy("idx"))
    hs = history.select(by, at, "idx", "draw").withColumn("_w", within).join(first, [by, at]).select(by, (F.col("_first") + F.col("_w")).alias("_r"), "idx", "draw")
    ts = u.where("_k = 0 AND _r > 0").select(by, F.col(at).alias("target"), F.explode(F.sequence(F.col("_r"), F.greatest(F.col("_r") - (w - 1), F.lit(1)), F.lit(-1))).alias("_r"))
    return ts.join(hs, [by, "_r"]).drop("_r")


def drift(before: DataFrame, after: DataFrame, name: str = "name", value: str = "value", current_only: bool = False) -> DataFrame:
    """Changes per feature over the union of names (or the names of ``after``), a missing one counts 0."""
    b, a = before.select(name, F.col(value).alias("_b")), after.select(name, F.col(value).alias("_a"))
    j = b.join(a, name, "right_outer" if current_only else "full_outer")
    return j.select(name, F.coalesce("_b", F.lit(0.0)).alias("before"), F.coalesce("_a", F.lit(0.0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def movers(changes: DataFrame, name: str, n: int) -> DataFrame:
    """side, rank_no, name, delta of the n greatest gainers and losers of ``drift``, ties by name."""
    out = None
    for side, order in (("gainer", F.desc("delta")), ("loser", F.asc("delta"))):
        top = changes.orderBy(order, name).limit(n)
        d = top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, name)).alias("rank_no"), name, "delta")  # n rows
        out = d if out is None else out.unionByName(d)
    return out


def turnover(changes: DataFrame, name: str, n: int) -> DataFrame:
    """One row: the share of the n greatest of ``after`` that aren't among the n greatest of ``before``."""
    top = lambda c: changes.orderBy(F.desc(c), name).limit(n).select(name)
    return top("after").join(F.broadcast(top("before")), name, "left_anti").agg((F.count(F.lit(1)) / n).alias("turnover"))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row in a total order, without a window over all rows: rows are range-partitioned and written
    in order with the number of their part, places count within a part, and the sizes of the parts before are added."""
    src = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = written(src.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    size = x.groupBy("_p").agg((F.max("_at") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per part
    return x.join(F.broadcast(size.select("_p", before.alias("_before"))), "_p").withColumn(name, F.col("_at") + F.col("_before")).drop("_p", "_at", "_before")


def sample(df: DataFrame, ident: str, number: int, n: int) -> DataFrame:
    """At most n rows without replacement, drawn by a hash keyed with ``number``: the same rows in every run and at every partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(number)), F.col(ident).cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("_h", h).orderBy("_h", ident).limit(n).drop("_h")


def enrichment(df: DataFrame, by: str, inside: str, rare: str, group: str, target: float = 0.1, least: int = 10, share: tuple[float, float] = (0.01, 0.4)) -> DataFrame:
    """Per ``by``: kept, reason, objective of a subset: how much likelier rare rows are in it, the groups it covers, and a capped
    penalty for its size. Subsets that keep too few or too many rows are rejected with -1."""
    inn, one = F.col(inside), lambda c: F.col(c).cast("int")
    a = df.groupBy(by).agg(
        F.count_if(inn).alias("kept"), F.count(F.lit(1)).alias("n"), (F.avg(F.when(inn, one(rare))) + 1e-6).alias("ps"), (F.avg(one(rare)) + 1e-6).alias("pg"),
        (F.count_distinct(F.when(inn, F.col(group))) / F.count_distinct(group)).alias("cov"),
    )
    keep = F.col("kept") / F.col("n")
    reason = F.when(F.col("kept") < least, "too_small").when(keep < share[0], "keep_too_low").when(keep > share[1], "keep_too_high").otherwise("ok")
    worth = 0.7 * F.tanh(F.ln(F.col("ps") / F.col("pg"))) + 0.2 * F.col("cov") - 0.1 * F.least(F.abs(F.ln((keep + 1e-9) / target)), F.lit(2.0))
    return a.select(by, "kept", reason.alias("reason"), F.when(reason == "ok", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), worth))).otherwise(-1.0).alias("objective"))


def pattern_statistics(c: str) -> list[Column]:
    """skip_min, skip_max, skip_mean, skip_std (of all), skip_unique of an array of skips; null for an empty one."""
    n, total = F.size(c), F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n)
    var = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return [F.array_min(c).alias("skip_min"), F.array_max(c).alias("skip_max"), F.round(mean, 6).alias("skip_mean"), F.when(n > 0, F.round(F.sqrt(var), 6)).alias("skip_std"), F.size(F.array_distinct(c)).alias("skip_unique")]


def overfitting(ratio: Column, val_mae: Column, test_mae: Column, p_value: Column) -> Column:
    """Whether a model's errors grow from training to validation or test, or its result is chance."""
    return (ratio > 1.5) | (test_mae > val_mae * 1.3) | (p_value > 0.05)


def composite(over: Column) -> Column:
    """Score from test_variance, test_mae, variance_consistency, temporal_stability, p_value and r2, halved where overfitted."""
    s = F.col("test_variance") * 10 + 1 / (F.col("test_mae") + 0.01) * 5 + F.col("variance_consistency") * 3 + F.col("temporal_stability") * 2 + (1 - F.col("p_value")) * 2 + F.col("r2") * 10
    return s * F.when(over, 0.5).otherwise(1.0)


def health(df: DataFrame, order: str) -> DataFrame:
    """Per period (hits, pool, survivors): hit rate, its decay and the change of the survivors' number against the period before, misses
    in a row and a state. One row per period."""
    w = Window.orderBy(order)
    d = df.withColumn("current_hit_rate", F.round(F.col("hits") / F.greatest("pool", F.lit(1)), 4)).withColumn("_i", F.sum((F.col("hits") > 0).cast("int")).over(w))
    r, p, s, q = F.col("current_hit_rate"), F.lag("current_hit_rate").over(w), F.col("survivors"), F.lag("survivors").over(w)
    d = d.select(
        order, "current_hit_rate", F.round(F.when(p > 0, F.greatest(F.lit(0.0), (p - r) / p)).otherwise(0.0), 4).alias("window_decay"), F.round(F.when(q > 0, F.abs(s - q) / q).otherwise(0.0), 4).alias("survivor_churn"),
        F.sum((F.col("hits") == 0).cast("int")).over(Window.partitionBy("_i").orderBy(order)).alias("consecutive_misses"),
    )
    m, decay = F.col("consecutive_misses"), F.col("window_decay")
    return d.withColumn("model_stability", F.when(m >= 5, "degraded").when((m >= 3) | (decay > 0.3), "warning").when(F.col("survivor_churn") > 0.3, "unstable").otherwise("stable"))


def variance_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, spread, range, distinct values and shares of zeros and nulls per feature, with a flag. One pass: unpivot, then aggregate."""
    x = df.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], features, "feature", "value")
    g = x.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("distinct_values"),
        F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("null_share"),
    )
    return g.withColumn("flag", F.when(F.col("distinct_values") <= 1, "constant").when(F.col("zero_share") > 0.95, "sparse").otherwise("ok"))


def signal_quality(df: DataFrame, target: str) -> DataFrame:
    """Whether a target carries signal: unique values, spread, share of non-zeros."""
    y = F.col(target).cast("double")
    g = df.agg(F.count_distinct(y).alias("unique_values"), F.var_pop(y).alias("variance"), F.avg(y).alias("mean"), F.avg((y != 0).cast("double")).alias("nonzero_share"))
    status = F.when((F.col("unique_values") <= 1) | (F.col("variance") < 1e-12), "degenerate").when((F.col("unique_values") < 10) | (F.col("nonzero_share") < 0.05), "weak").otherwise("healthy")
    return g.withColumn("status", status).withColumn("prediction_allowed", F.col("status") != "degenerate")


def duplicate_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that are equal in all of ``cols``, by digest."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)).cast("binary"))
    g = df.groupBy(h.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum((F.col("n") > 1).cast("int")).alias("repeated_groups"), F.max("n").alias("most"))


def fit(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """R2 (0 without spread), MSE and MAE."""
    m = df.agg(F.avg(y).alias("_m"))
    e = F.col(y) - F.col(yhat)
    g = df.crossJoin(F.broadcast(m)).agg(F.sum(e * e).alias("res"), F.sum((F.col(y) - F.col("_m")) * (F.col(y) - F.col("_m"))).alias("tot"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return g.select(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0).alias("r2"), "mse", "mae")


def nearest_by_cosine(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int, least_shared: int = 0) -> DataFrame:
    """The k most similar vectors to each query, exactly, in blocks.

    Queries are gathered to blocks of a fixed number of rows; each block meets each batch of the base once, as one matrix product,
    and passes on only k candidates per query and batch, which are ranked at the end.
    """
    import numpy as np
    import pandas as pd

    block = 2048
    q = queries.select(F.col(ident).alias("_q"), F.col(vector).alias("_v")).withColumn("_blk", F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-queries.count() // block)))))
    packs = q.groupBy("_blk").agg(F.collect_list(F.struct("_q", "_v")).alias("pack"))  # about ``block`` rows each
    chunk = base.select(F.col(ident).alias("_i"), F.col(vector).alias("_w")).withColumn("_c", F.spark_partition_id() * 100_000 + F.floor(F.monotonically_increasing_id() % (1 << 33) / 4096).cast("int"))
    chunks = chunk.groupBy("_c").agg(F.collect_list(F.struct("_i", "_w")).alias("rows"))  # at most 4096 rows each
    kind = base.schema[ident].dataType.simpleString()

    def score(it):  # noqa: ANN001, ANN202
        for pdf in it:
            for pack, rows in zip(pdf["pack"], pdf["rows"]):
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                a, b = (unit(np.array([np.asarray(r[f], float) for r in part])) for part, f in ((pack, "_v"), (rows, "_w")))
                qi, bi = np.array([r["_q"] for r in pack]), np.array([r["_i"] for r in rows])
                s = np.round(a @ b.T, 9)
                s[qi[:, None] == bi[None, :]] = -2
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qi, at.shape[1]), "neighbour_id": bi[at].ravel(), "cosine": np.take_along_axis(s, at, 1).ravel()})

    pairs = chunks.crossJoin(packs)  # blocks by blocks: the stated query set against all rows
    got = pairs.select("pack", "rows").mapInPandas(score, f"query_id {kind}, neighbour_id {kind}, cosine double").where("cosine > -1.5")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id")
    return got.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)
