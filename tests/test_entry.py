"""The driver's contract: names, SQL, the package on the executors, folders of part files."""

import pandas as pd

import __spark_entry__ as entry
from drawloom.queries import core
from drawloom.session import ship


def test_every_oracle_has_a_query_and_names_are_unique():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) == sum(len(m.queries()) for m in entry._MODULES)


def test_ship_twice_and_read_part_files(spark, tmp_path):
    ship(ship(spark))
    t = pd.Timestamp("2025-03-01")
    tables = {
        "attempts": pd.DataFrame({"id": [1, 1, 2], "fingerprint": [" AB", " AB", "x "], "run_id": ["r", "r", " "], "attempted_at": [t, t, t]}),
        "fingerprint_summary": pd.DataFrame({"fingerprint": ["ab\t", "zz"], "first_seen": [t, t], "deleted_at": pd.Series([pd.NaT, t])}),
        "runs": pd.DataFrame({"run_id": ["q"], "started_at": [t], "deleted_at": pd.Series([t])}),
    }
    for n, d in tables.items():
        (tmp_path / f"{n}.parquet").mkdir()
        d.to_parquet(tmp_path / f"{n}.parquet" / "part-0.parquet", coerce_timestamps="us")
    got = {tuple(r) for r in core.p4_found(spark, str(tmp_path)).collect()}
    assert got == {("attempts.fingerprint", "2", "2025-03", "missing"), ("attempts.run_id", "1", "2025-03", "missing"), ("fingerprint_summary.fingerprint", "zz", "2025-03", "missing")}


def test_valid_configs_counts_repeated_ids_once(spark, tmp_path):
    t = pd.DataFrame({"id": [1, 1, 2, 3], "trial_number": [7, 7, 7, 8], "skip_min": 0, "skip_max": 10, "window_size": [8, 8, 8, 0], "forward_threshold": 0.3, "reverse_threshold": 0.3})
    t.to_parquet(tmp_path / "step1_trial_history.parquet")
    assert [tuple(r) for r in entry.queries()["valid_configs"](spark, str(tmp_path)).collect()] == [(7, 2)]


def test_sorted_survivors_sums_beyond_64_bits(spark, tmp_path):
    for name, top in (("small", 3), ("large", 1 << 62)):
        (tmp_path / name).mkdir()
        pd.DataFrame({"o_orderkey": [top, top - 1, top - 2]}).to_parquet(tmp_path / name / "orders.parquet")
        pd.DataFrame({"l_orderkey": [top, top, top - 2, top - 1], "l_quantity": [41.0, 50.0, 41.0, 40.0]}).to_parquet(tmp_path / name / "lineitem.parquet")
        df = entry.queries()["sorted_survivors"](spark, str(tmp_path / name))
        want = {("forward", 3, top - 1 + 2 * top), ("reverse", 2, top), ("bidirectional", 2, top)}
        assert {tuple(map(str, r)) for r in df.collect()} == {tuple(map(str, r)) for r in want}
        assert df.schema["checked"].dataType.simpleString() == ("bigint" if name == "small" else "decimal(38,0)")
