"""The best items against a sort, skipping, ties and hot groups."""

import random

import pandas as pd
import pyarrow.parquet as pq

from drawloom.llm import topn


def _brute(rows, n):
    best = {}
    for g, s, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        best.setdefault(g, []).append(i)
    return {(g, r + 1, i) for g, ids in best.items() for r, i in enumerate(ids[:n])}


def test_against_sorting_with_a_hot_group_and_ties(spark):
    rnd = random.Random(5)
    rows = [("hot", round(rnd.random(), 2), i) for i in range(20_000)] + [(f"g{rnd.randrange(4000)}", round(rnd.random(), 1), 20_000 + i) for i in range(12_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "score", "id"]))
    for size in (4 * 1024, 256 * 1024):
        got = {(r.g, r.rank_no, r.id) for r in topn.top_n(df, ["g"], "score", "id", 3, row_group_bytes=size).collect()}
        assert got == _brute(rows, 3)


def test_row_groups_of_a_large_group_are_skipped(tmp_path):
    t = pd.DataFrame({"g": ["a"] * 9000 + ["b"] * 10, "score": [1 - i / 9000 for i in range(9000)] + [0.5] * 10, "id": range(9010)})
    f = tmp_path / "x.parquet"
    t.to_parquet(f, row_group_size=1000)
    read = dict(topn.read_best(pq.ParquetFile(f), ["g"], "score", 3))
    assert sorted(read) == [0, 9]  # the first thousand of a and the rest, which holds b as well
    assert [r.no for r in topn.plan(pq.ParquetFile(f).metadata, ["g"], "score")][:2] == [0, 1]


def test_ties_across_row_groups_are_read(tmp_path):
    t = pd.DataFrame({"g": ["a"] * 4000, "score": [1.0] * 4000, "id": range(4000)})
    f = tmp_path / "x.parquet"
    t.to_parquet(f, row_group_size=1000)
    assert len(list(topn.read_best(pq.ParquetFile(f), ["g"], "score", 3))) == 4


def test_unique_items_nulls_and_empty(spark):
    nan = float("nan")
    rows = [("a", 1, 0.5, 9, "h"), ("a", 1, 0.5, 4, "h"), ("a", 1, 0.5, 4, "h"), ("a", 1, None, 5, "x"), ("a", 1, nan, 6, "y"), (None, 1, 0.7, 7, "z"), ("a", None, 0.7, 8, "w"), ("a", 1, 0.9, 10, None)]
    df = spark.createDataFrame(rows, "p string, seed long, score double, id long, h string")
    items = topn.unique_items(df, ["p", "seed"], "score", "id", ["h"])
    got = [(r.p, r.seed, r.rank_no, r.id) for r in topn.top_n(items, ["p", "seed"], "score", "id", 3).orderBy("rank_no").collect()]
    assert got == [("a", 1, 1, 10), ("a", 1, 2, 4)]
    assert topn.top_n(items.where("false"), ["p", "seed"], "score", "id", 3).count() == 0


def test_groups_over_files_and_unread_row_groups(spark, tmp_path):
    """Three hot groups over several files, ties at the N-th place, equal items: the winners, with most row groups unread."""
    rnd = random.Random(9)
    rows = [(f"h{i % 3}", i % 5, round(rnd.random(), 3), i, f"k{i // 2}") for i in range(60_000)] + [(f"s{i}", 0, 0.5, 60_000 + i, "k") for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "s", "score", "id", "k"]))
    seen, uniq = set(), []
    for r in rows:
        if (r[0], r[1], r[4]) not in seen:
            seen.add((r[0], r[1], r[4]))
            uniq.append(((r[0], r[1]), r[2], r[3]))
    for same, want in ((["k"], uniq), (None, [((r[0], r[1]), r[2], r[3]) for r in rows])):
        got = {((r.g, r.s), r.rank_no, r.id) for r in topn.top_n(df, ["g", "s"], "score", "id", 3, row_group_bytes=4096, same=same).collect()}
        assert got == _brute(want, 3)
    s = topn.skipping(df, ["g", "s"], "score", "id", 3, row_group_bytes=4096, same=["k"]).collect()
    assert sum(r.n_rows for r in s) == len(uniq) and sum(r.groups_read for r in s) < 0.5 * sum(r.row_groups for r in s)


def test_edges_and_insides_of_a_file(tmp_path):
    rows = [("a", 1, 1 - i / 3000, i) for i in range(3000)] + [("b", i, 0.5, i) for i in range(40)] + [("c", 9, 1 - i / 3000, i) for i in range(3000)]
    f = tmp_path / "x.parquet"
    pd.DataFrame(rows, columns=["g", "s", "score", "id"]).to_parquet(f, row_group_size=500)
    p = pq.ParquetFile(f)
    assert topn.edge_groups(p, ["g", "s"]) == (("a", 1), ("c", 9))
    edge, inner = (topn.winners(p, ["g", "s"], "score", 3, e) for e in (True, False))
    assert edge.column("g").to_pylist() == ["a"] * 3 + ["c"] * 3 and edge.column("rank_no").to_pylist() == [1, 2, 3, 1, 2, 3]
    assert inner.column("g").to_pylist() == ["b"] * 40 and set(inner.column("rank_no").to_pylist()) == {1}
    assert len(list(topn.read_best(p, ["g", "s"], "score", 3, False))) == 1


def test_unknown_file_system_is_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(topn, "scratch_path", lambda spark, name: f"abfss://x@y/{name}")
    with pytest.raises(ValueError, match="shared folder"):
        topn.cluster(spark.range(1).selectExpr("id", "id as g", "1.0D as score"), ["g"], "score", "id")
