"""Changes between files on written-out cases."""

import json

from drawloom.operators import schema_drift as S


def _df(spark, files):
    rows = [(w, n, i + 1, r if r is None or isinstance(r, str) else json.dumps(r)) for (w, n), recs in files.items() for i, r in enumerate(recs)]
    return spark.createDataFrame(rows, "writer_id string, file_no long, line_no int, raw string").selectExpr("*", "'x' AS types", "'y' AS path")


def _changes(spark, files):
    f = S.file_fields(_df(spark, files), "t").cache()
    return {(r.writer_id, r.file_no, r.change_kind, r.field_path, r.old_value, r.new_value) for r in S.changes(f).collect()}


def test_added_removed_retyped_and_gaps(spark):
    files = {
        ("w", 1): [{"a": 1, "b": {"c": "x", "d": None}, "e": [1, {"f": 2}]}],
        ("w", 4): [{"a": "1", "b": {"c": "x", "d": True}}, "torn {", "", None, "null", "[1]", '{"z": NaN}'],
        ("w", 5): ["  ", "not json"],
        ("w", 9): [{"a": 1.5}, {"a": "x"}, {"b": {}}],
        ("v", 2): [{"a": 1}],
    }
    assert _changes(spark, files) == {
        ("w", 4, "retyped", "a", "number", "string"),
        ("w", 4, "added", "b.d", "", "boolean"),
        ("w", 4, "removed", "e", "array", ""),
        ("w", 9, "retyped", "a", "string", "number|string"),
        ("w", 9, "removed", "b.c", "string", ""),
        ("w", 9, "removed", "b.d", "boolean", ""),
    }


def test_renames_by_content_and_names_that_never_meet(spark):
    kinds, acts = ["alpha", "beta", "gamma"], ["STOP", "GO"]
    rec = lambda i, k, a: {k: kinds[i % 3], a: acts[i % 2], "n": i}
    files = {
        ("w", 1): [rec(i, "model_type", "action") for i in range(6)],
        ("w", 2): [rec(i, "model", "action") for i in range(6)],
        ("w", 3): [{"meta": {"model": kinds[i % 3]}, "nextAction": acts[i % 2], "n": i} for i in range(6)],
        ("v", 1): [{"alpha": "same words", "n": 1}],
        ("v", 2): [{"beta": "same words", "n": 1}],
        ("u", 7): [{"alpha": "same words", "beta": "same words"}],
    }
    assert _changes(spark, files) == {
        ("w", 2, "renamed", "model_type", "string", "model"),
        ("w", 3, "renamed", "model", "string", "meta.model"),
        ("w", 3, "renamed", "action", "string", "nextAction"),
        ("v", 2, "added", "beta", "", "string"),
        ("v", 2, "removed", "alpha", "string", ""),
    }


def test_neighbours_over_blocks(spark):
    df = spark.createDataFrame([("t", "w", n) for n in (1, 2, 9, 10, 35, 36)] + [("t", None, 3), ("t", None, 4)], "src_table string, writer_id string, file_no long")
    got = {(r.writer_id, r.file_no): (r.prev_no, r.next_no) for r in S.neighbours(df, block=10).collect()}
    assert got == {("w", 1): (None, 2), ("w", 2): (1, 9), ("w", 9): (2, 10), ("w", 10): (9, 35), ("w", 35): (10, 36), ("w", 36): (35, None), (None, 3): (None, 4), (None, 4): (3, None)}


def test_consistent_table_and_promotion(spark):
    files = {("w", 1): [{"a": 1, "b": "x y z", "k": [1]}, "torn"], ("w", 2): [{"a": "two", "B": "x y z", "k": ["q"]}], ("w", 3): [{"A": {"c": True}, "a": 3, "B": "x y z", "line_no": 7}]}
    df = _df(spark, files)
    f = S.file_fields(df, "t").cache()
    out = S.consistent(df, f, S.changes(f), ["writer_id", "file_no", "line_no"])
    assert dict(out.dtypes) == {"writer_id": "string", "file_no": "bigint", "line_no": "int", "A__c": "boolean", "B": "string", "a": "string", "k": "array<string>", "line_no_": "bigint"}
    rows = {r.file_no: r for r in out.collect()}
    assert [rows[i]["B"] for i in (1, 2, 3)] == ["x y z"] * 3 and [rows[i]["a"] for i in (1, 2, 3)] == ["1", "two", "3"]
    assert rows[3]["A__c"] is True and rows[3]["line_no_"] == 7 and rows[1]["k"] == ["1"]
    assert S.promote({"number"}) == "number" and S.promote({"number", "boolean"}) == "string"


def test_empty_table(spark):
    assert _changes(spark, {("w", 1): ["x"]}) == set()


def test_odd_values_do_not_crash(spark):
    deep = "x"
    for _ in range(300):
        deep = {"d": deep}
    files = {("w", 1): [{"big": 10**400, "wide": 1e308, "": {"": 1}}, '{"s": "\\ud800", "\\udfff": 1}', '{"k": 1, "k": "two"}', deep], ("w", 2): ["{}", "[" * 100_000]}
    got = _changes(spark, files)
    assert {r[2] for r in got} == {"removed"} and ("w", 2, "removed", "k", "string", "") in got and ("w", 2, "removed", ".", "number", "") in got
    out = S.consistent(_df(spark, files), S.file_fields(_df(spark, files), "t").cache(), spark.createDataFrame([], "change_kind string, field_path string, new_value string"), ["writer_id"])
    assert out.count() == 5


def test_more_renames_than_the_bound_are_refused(spark, monkeypatch):
    import pytest

    from drawloom.operators import schema_drift

    monkeypatch.setattr(schema_drift, "MOST_PATHS", 3)
    df = spark.createDataFrame([("w", 1, '{"a": 1, "b": 2, "c": 3}')], "writer_id string, file_no long, raw string")
    fields = schema_drift.file_fields(df, "t")
    pairs = lambda n: spark.createDataFrame([("renamed", o, x) for o, x in [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")][:n]], "change_kind string, field_path string, new_value string")
    assert schema_drift.consistent(df, fields, pairs(3), ["writer_id", "file_no"]).count() == 1
    with pytest.raises(ValueError, match="renames"):
        schema_drift.consistent(df, fields, pairs(4), ["writer_id", "file_no"])


def test_numbers_keep_all_digits(spark):
    recs = [{"whole": 2**53 + 1, "wide": 2**63, "frac": 1.5, "both": 2**53 + 1, "huge": 10**40}, {"whole": -(2**63), "wide": 1, "frac": 2, "both": 0.5, "huge": 1}]
    df = _df(spark, {("w", 1): recs})
    f = S.file_fields(df, "t").cache()
    out = S.consistent(df, f, S.changes(f), ["writer_id"])
    assert dict(out.dtypes) == {"writer_id": "string", "both": "string", "frac": "double", "huge": "string", "whole": "bigint", "wide": "decimal(38,0)"}
    got = sorted(out.collect(), key=lambda r: r.frac)
    assert [(r.whole, int(r.wide), r.frac, r.both, r.huge) for r in got] == [(2**53 + 1, 2**63, 1.5, str(2**53 + 1), str(10**40)), (-(2**63), 1, 2.0, "0.5", "1")]
    assert [S.promote({"number"}, n) for n in ({"int53"}, {"int64", "int53"}, {"int38"}, {"float", "int53"}, {"float", "int64"}, {"big"})] == ["long", "long", "decimal", "number", "string", "string"]
