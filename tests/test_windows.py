"""Ordered operations in blocks against plain lists."""

import random

from pyspark.sql import functions as F

from drawloom.operators import policy, ranking, registry
from drawloom.operators import windows as W

V = [random.Random(4).randrange(4) for _ in range(500)]


def _df(spark):
    return spark.createDataFrame(list(enumerate(V)), "idx long, v long")


def test_lags_sums_and_positions_over_blocks(spark):
    x = W.lagged(_df(spark), "v", [1, 9], block=7)
    got = {r.idx: (r.v_lag1, r.v_lag9) for r in x.collect()}
    assert got == {i: (V[i - 1] if i else None, V[i - 9] if i >= 9 else None) for i in range(500)}
    s = {r.idx: r.s for r in W.running_sum(_df(spark), F.col("v"), "s", block=7).collect()}
    assert s == {i: sum(V[: i + 1]) for i in range(500)}
    odd = W.row_index(_df(spark).where("v > 1"), block=7)
    assert [r.pos for r in odd.orderBy("idx").collect()] == list(range(sum(v > 1 for v in V)))


def test_islands_and_the_open_run(spark):
    runs, i = [], 0
    while i < 500:
        j = i
        while j + 1 < 500 and V[j + 1] == V[i]:
            j += 1
        runs.append((V[i], i, j, j - i + 1))
        i = j + 1
    got = sorted(((r.v, r.first, r.last, r.length) for r in W.islands(_df(spark), "v", block=11).collect()), key=lambda r: r[1])
    assert got == runs
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)], "idx long, v long")
    assert [(r.first, r.length) for r in W.streaks(df, "v").collect()] == [(0, 2)]


def test_sliding_and_scan(spark):
    got = {}
    for r in W.sliding(_df(spark), 40, 15).collect():
        got.setdefault(r.win, set()).add(r.idx)
    assert got == {k: set(range(k * 15, k * 15 + 40)) for k in range((500 - 40) // 15 + 1)}
    d = spark.createDataFrame([(i, i % 2 and "a" or "b") for i in range(20)], "idx long, session string")
    assert [(r.idx, r.pos) for r in W.window_scan(d, 4, 8, ["a"]).orderBy("pos").collect()] == [(13, 0), (15, 1), (17, 2), (19, 3)]
    assert W.window_scan(d, 11, 0, ["a"]).count() == 0


def test_policy_rules(spark):
    df = spark.range(100).selectExpr("id AS seed", "50 + id * 0.5D AS score", "CASE WHEN id % 10 = 0 THEN NULL ELSE id / 100D END AS f")
    assert policy.apply(df, {}).count() == 100
    assert policy.policy_filter(df, "f", "gte", 0.4).count() == 54
    low = policy.policy_filter(df, "f", "lt", -1).collect()
    assert len(low) == 50 and sum(r.f is None for r in low) == 10
    w = {r.seed: r.score for r in policy.policy_weight(df, "score", "linear").collect()}
    assert w[0] == 50 and w[99] == 99.5 * 2
    same = policy.policy_weight(df.withColumn("k", F.lit(1.0)), "k", "linear").first()
    assert same.score == 75
    assert policy.policy_window(df, 10, 0).count() == 90 and policy.fingerprint({"a": 1, "b": 2}) == policy.fingerprint({"b": 2, "a": 1})
    for bad in (lambda: policy.policy_mask(df, ["score"]), lambda: policy.policy_filter(df.limit(10), "f", "gt", 5)):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass


def test_upserts_and_empty_tables(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    n = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k long, v string")
    assert sorted(tuple(r) for r in registry.upsert(s, n, ["k"], [F.col("v")]).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(r.k for r in registry.insert_absent(s, n, ["k"]).collect()) == [1, 2, 3]
    assert registry.upsert(s.where("false"), n.where("false"), ["k"]).count() == 0
    assert ranking.duplicate_audit(spark.createDataFrame([(1, None), (1, None), (None, 1)], "a long, b long"), ["a", "b"]).first().distinct_rows == 2


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "i long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in ranking.nearest_by_cosine(df.where("i % 50 = 0"), df, "i", "v", 3).collect():
        got.setdefault(r.query_id, {})[r.rank_no] = r.neighbour_id
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -2
        assert [got[q][k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()
