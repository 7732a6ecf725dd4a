"""Orphan references against brute force."""

import datetime as dt
import random

import pytest

from drawloom.operators import references

T0 = dt.datetime(2025, 1, 1)


def _brute(refs, recs):
    out = set()
    for i, k, at, per in set(refs):
        if k is None:
            continue
        mine = [(s, e) for kk, s, e in recs if kk == k]
        if not mine:
            out.add((i, per, "missing"))
        elif at is not None and not any((s is None or s <= at) and (e is None or e > at) for s, e in mine):
            out.add((i, per, "late" if all(s is not None and s > at for s, _ in mine) else "deleted"))
    return out


def _frames(spark, refs, recs):
    r = spark.createDataFrame(refs, "ref_id string, key string, at timestamp_ntz, period string").selectExpr("*", "'x' AS start", "1 AS n")
    c = spark.createDataFrame(recs, "key string, start timestamp_ntz, end timestamp_ntz").selectExpr("*", "'y' AS period", "'z' AS spans")
    return r, c


@pytest.mark.parametrize("least,most", [(50, 20_000), (10**9, 20_000), (50, 0), (None, 20_000), (None, 1)])
def test_against_brute_force_with_a_hot_key(spark, least, most):
    rnd = random.Random(8)
    day = lambda a=0, b=120: T0 + dt.timedelta(hours=rnd.randrange(a * 24, b * 24))
    keys = [f"k{i}" for i in range(80)]
    recs = [(k, s := day(0, 60), None if rnd.random() < 0.4 else s + dt.timedelta(days=rnd.randrange(1, 40))) for k in keys[:60] for _ in range(rnd.choice([1, 1, 2, 3]))]
    recs += recs[:20] + [("k0", None, T0 + dt.timedelta(days=5)), (None, T0, None)]
    refs = []
    for i in range(3000):
        k = "k3" if i % 3 == 0 else rnd.choice([*keys, None])
        at = None if rnd.random() < 0.02 else day()
        refs.append((str(i), k, at, at and at.strftime("%Y-%m")))
    refs += refs[:50]
    rows, counts = references.orphans(*_frames(spark, refs, recs), least=least, most=most)
    want = _brute(refs, recs)
    got = [(r.ref_id, r.period, r.why) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    per = {}
    for _, p, w in want:
        per[p, w] = per.get((p, w), 0) + 1
    assert {(r.period, r.why): r.n for r in counts.collect()} == per


def test_edges_and_empty_tables(spark):
    t = lambda d: T0 + dt.timedelta(days=d)
    refs = [("a", "k", t(1), "p"), ("b", "k", t(3), "p"), ("c", "k", t(0), "p"), ("d", "gone", t(1), "p")]
    recs = [("k", t(1), t(3))]
    r, c = _frames(spark, refs, recs)
    assert {(x.ref_id, x.why) for x in references.orphans(r, c)[0].collect()} == {("b", "deleted"), ("c", "late"), ("d", "missing")}
    assert {x.why for x in references.orphans(r, c.where("false"))[0].collect()} == {"missing"}
    assert references.orphans(r.where("false"), c)[0].count() == 0
    assert [x.key for x in references.never_referred(c, r.where("key <> 'k'")).collect()] == ["k"]


def test_heavy_keys_are_split_by_broadcast_or_salt(spark):
    """A key with a third of all rows: found from the cells, apart from the others, in many parts where the other side is too large."""
    refs = [(str(i), "hot" if i % 3 == 0 else f"k{i % 50}", T0 + dt.timedelta(hours=i), "p") for i in range(900)]
    r, c = _frames(spark, refs, [("hot", T0 + dt.timedelta(hours=450), None)])
    for most, plan in ((20_000, "BroadcastHashJoin"), (0, "_salt")):
        j = references.judge(r, c, most=most)
        assert [x.key for x in j.heavy.collect()] == ["hot"]
        rows = j.rows()
        assert plan in rows._jdf.queryExecution().toString()
        got = {(x.ref_id, x.why) for x in rows.collect()}
        assert got == {(i, "late" if k == "hot" else "missing") for i, k, at, _ in refs if k != "hot" or at < T0 + dt.timedelta(hours=450)}
