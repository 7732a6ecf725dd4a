"""Containers against plain first-fit decreasing, and their bounds."""

import random

import numpy as np

from drawloom.llm import packing


def _plain(sizes, cap):
    free, out = [], []
    for s in sizes:
        for i, f in enumerate(free):
            if f >= s:
                break
        else:
            i = len(free)
            free.append(cap)
        free[i] -= s
        out.append(i)
    return out


def test_same_as_plain_first_fit_decreasing():
    rnd = random.Random(2)
    for n in (1, 5, 200, 1500):
        sizes = sorted((rnd.choice([rnd.randint(1, 100), rnd.randint(1, 20), 34]) for _ in range(n)), reverse=True)
        assert packing.first_fit_decreasing(np.array(sizes), 100).tolist() == _plain(sizes, 100)


def test_pack_keeps_every_item_whole(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, None, rnd.randint(1, 99), rnd.randint(1, 30), rnd.randint(101, 1000), 100, 200])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n int")
    got = packing.pack(df, "doc_id", "n", 100, group_items=700).collect()
    load, pieces = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_units
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.n_units))
    assert max(load.values()) <= 100
    for i, n in rows:
        p = sorted(pieces[i])
        assert sum(x for _, x in p) == (n or 0) and [k for k, _ in p] == list(range(len(p))) and all(x == 100 for _, x in p[:-1])
    groups = len({c >> 32 for c in load})
    assert groups == 5 and len(load) <= sum(n or 0 for _, n in rows) / 100 * 1.03 + groups


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, None)], "doc_id long, n int")
    assert {r.container for r in packing.pack(df, "doc_id", "n", 10).collect()} == {0}
    assert packing.pack(df.where("false"), "doc_id", "n", 10).count() == 0


def test_equal_rows_are_spread_and_runs_agree(spark):
    """One id a third of all rows, dealt over the groups; the same containers however the rows come."""
    rows = [(7, 30)] * 3000 + [(i, i % 90) for i in range(100, 6000)]
    df = spark.createDataFrame(rows, "i long, n long")
    a, b = (sorted(map(tuple, packing.pack(d, "i", "n", 100, group_items=500).collect())) for d in (df, df.repartition(5)))
    assert a == b and len(a) == len(rows)
    hot = [x[3] >> 32 for x in a if x[0] == 7]
    assert len(set(hot)) == 18 and max(hot.count(g) for g in set(hot)) < 300
