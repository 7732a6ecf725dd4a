"""Digests against exact ranks, merging, compression and odd values."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from drawloom.llm import percentiles as P

PROBS = [0.5, 0.9, 0.95, 0.99]


def _rank_ok(values, q, lo, hi, slack):
    v = np.sort(values)
    rank = int(np.ceil(q * len(v)))
    return np.sum(v < lo) - slack < rank <= np.sum(v <= hi) + slack


def test_rank_error_bound_after_compressing_and_merging(spark):
    rng = np.random.default_rng(3)
    n, k = 60_000, 256
    v = np.concatenate([rng.lognormal(1, 2, n), np.full(5_000, 2.5), -rng.random(500), np.zeros(3_000), [np.inf, -np.inf, 1e300, 5e-324]])
    pdf = pd.DataFrame({"g": "a", "day": (np.arange(len(v)) % 9).astype(str), "v": v})
    d = P.digest(spark.createDataFrame(pdf), "v", ["g", "day"], k)
    assert d.groupBy("day").count().agg(F.max("count")).first()[0] <= 3 * k + P.LOG_U
    merged = P.compress(P.merge(d, ["g"]), ["g"], k)
    assert merged.count() <= 3 * k + P.LOG_U
    assert merged.agg(F.sum("n")).first()[0] == len(v)
    for x in (P.merge(d, ["g"]), merged):
        q = P.quantiles(x, ["g"], PROBS, k)
        cols = [c for p in PROBS for c in P.edges(F.col(f"leaf_{round(p * 100)}"))]
        row = q.select("n", "rank_error", *(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
        assert row.n == len(v) and row.rank_error <= P.LOG_U * len(v) / k
        for i, p in enumerate(PROBS):
            assert _rank_ok(v, p, row[f"c{2 * i}"], row[f"c{2 * i + 1}"], row.rank_error)


def test_small_groups_are_exact_up_to_quantization(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0, None, float("nan"))] + [("b", -7.0), ("c", float("nan")), (None, 0.0)], "g string, v double")
    q = P.quantiles(P.digest(df, "v", ["g"]), ["g"], PROBS)
    got = {r.g: r for r in q.select("g", "n", "rank_error", P.value_of(F.col("leaf_50")).alias("p50"), P.value_of(F.col("leaf_99")).alias("p99")).collect()}
    assert set(got) == {"a", "b", None} and got["a"].n == 4 and got["a"].rank_error == 0
    assert abs(got["a"].p50 / 2 - 1) < 0.0011 and abs(got["a"].p99 / 4 - 1) < 0.0011
    assert abs(got["b"].p50 / -7 - 1) < 0.0011 and got[None].p50 == 0.0
    assert P.digest(df.where("false"), "v", ["g"]).count() == 0


def test_leaves_keep_the_order(spark):
    v = sorted([float("-inf"), -1e308, -3.0, -1e-320, 0.0, 5e-324, 1e-9, 1.0, 1.01, 3.0, 1e308, float("inf")])
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", P.leaf(F.col("v")).alias("l"))
    leaves = [r.l for r in df.orderBy("v").collect()]
    assert leaves == sorted(leaves) and len(set(leaves)) == len(leaves) and leaves[0] == 0 and leaves[-1] == (1 << P.LOG_U) - 1


def test_rows_delivered_twice_count_once(spark, tmp_path):
    import pandas as pd

    from drawloom.llm import queries

    t = pd.Timestamp("2025-03-01")
    rows = [(1, 1.0), (2, 2.0), (3, 100.0), (3, 100.0), (3, 100.0)]
    pd.DataFrame([{"id": i, "computed_at": t, "node_id": "n", "prng_type": "minstd", "runtime": x} for i, x in rows]).to_parquet(tmp_path / "cache_results.parquet", coerce_timestamps="us")
    got = queries.p2_percentiles(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.n == 3 and abs(r.p50 / 2 - 1) < 0.002 for r in got)
    checked = queries.p2_rank_check(spark, str(tmp_path)).collect()
    assert len(checked) == 4 and all(r.n == 3 and r.ok50 and r.ok99 for r in checked)


def test_many_small_digests_compress_once_merged(spark):
    """No day has k values, so daily digests are leaves; their merge is compressed by the N of all."""
    rng = np.random.default_rng(8)
    n, k = 40_000, 512
    v = rng.lognormal(0, 3, n)
    pdf = pd.DataFrame({"day": (np.arange(n) % 200).astype(str), "g": np.where(np.arange(n) % 3 == 0, "hot", "x"), "v": v})
    d = P.digest(spark.createDataFrame(pdf), "v", ["day", "g"], k)
    assert d.where(f"node >= {1 << P.LOG_U}").count() == 0
    m = P.merge(d, ["g"], k)
    assert m.where(f"node >= {1 << P.LOG_U}").count() > 0
    probs = [0.0, 0.5, 0.99, 0.994, 0.999]
    rows = {r.g: r for r in P.quantiles(d, ["g"], probs, k).collect()}
    again = {r.g: r for r in P.quantiles(m, ["g"], probs, k).collect()}
    assert set(rows["hot"].asDict()) == {"g", "n", "rank_error", "nodes", "inner", "leaf_00", "leaf_50", "leaf_99", "leaf_99_4", "leaf_99_9"}
    for g in ("hot", "x"):
        x = v[(pdf["g"] == g).to_numpy()]
        for r in (rows[g], again[g]):
            assert r.n == len(x) and r.nodes <= 3 * k + P.LOG_U and 0 < r.inner and r.nodes < m.count()
            for q in probs:
                e = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(P.edges(F.lit(r[P.leaf_name(q)]))))).first()
                assert _rank_ok(x, max(q, 1e-9), e.c0, e.c1, r.rank_error)


def test_groups_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(g, float(i)) for g, n in (("a", 50), ("b", 1), ("c", 7), (None, 30)) for i in range(n)], "g string, v double")
        got = {r.g: (r.n, r.nodes) for r in P.quantiles(P.digest(df, "v", ["g"]), ["g"], [0.5]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": (50, 50), "b": (1, 1), "c": (7, 7), None: (30, 30)}
