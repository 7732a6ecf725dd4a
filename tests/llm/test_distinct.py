"""Sketches against exact counts, merging, and odd input."""

import pandas as pd
from pyspark.sql import functions as F

from drawloom.llm import distinct


def test_error_bound_at_all_sizes_and_merge(spark):
    sizes = [1, 7, 300, 4_000, 60_000, 400_000]
    df = None
    for n in sizes:
        d = spark.range(n).select(F.lit(str(n)).alias("g"), (F.col("id") % 5).cast("string").alias("day"), (F.col("id") * 7919 + n).alias("x"))
        d = d.unionByName(d.limit(n // 2))
        df = d if df is None else df.unionByName(d)
    s = distinct.sketch(df, "x", [["g"], ["g", "day"]], ["g", "day"])
    whole = {r.g: r for r in distinct.estimate(s.where("grouping = 0"), ["g"]).collect()}
    merged = {r.g: r for r in distinct.estimate(distinct.merge(s.where("grouping = 1"), ["g"]), ["g"]).collect()}
    for n in sizes:
        r = whole[str(n)]
        assert abs(r.n_distinct - n) <= max(1, r.err_bound * n), (n, r)
        assert r.err_bound < 0.052
        assert merged[str(n)] == r


def test_nulls_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(None, 1, "s"), (None, 1, "s"), ("a", None, "s"), ("b", 2, None), ("b", -3, "t")], "g string, x long, slot string")
    got = {r.g: r.n_distinct for r in distinct.estimate(distinct.sketch(df, "x", [["g"]], ["g"]), ["g"]).collect()}
    assert got == {None: 1, "b": 2}
    assert distinct.estimate(distinct.sketch(df.where("false"), "x", [["g"]], ["g"]), ["g"]).count() == 0


def test_text_identifiers(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 4, "x": ["", "é" * 5000, "é" * 5000, " "]}))
    assert distinct.estimate(distinct.sketch(df, "x", [["g"]], ["g"]), ["g"]).first().n_distinct == 3
