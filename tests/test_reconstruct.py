"""Parameters from outputs, statistics against written-out cases, sources with a fallback."""

import numpy as np
import pytest

from drawloom.operators import generators as G
from drawloom.operators import reconstruct as B
from drawloom.sources import files


def test_registers_and_lags():
    v = [1, 0, 0, 1, 1]
    while len(v) < 40:
        v.append(v[-2] ^ v[-5])
    assert B.shortest_register(v) == [2, 5] and B.shortest_register([0] * 20) == []
    assert B.shortest_register(np.random.default_rng(1).integers(0, 2, 41).tolist()[:5]) in (None, [1], [2], [1, 2], [])
    x = list(range(3, 20))
    while len(x) < 60:
        x.append((x[-5] + x[-17]) % 100)
    assert B.lagged_pair(x, 100) == (5, 17) and B.lagged_pair([1, 2, 3], 10) is None and B.lagged_pair(np.random.default_rng(2).integers(0, 1000, 80).tolist(), 1000) is None


def test_xorshift_shifts():
    out = G.sequences("xorshift32", np.array([9, 123456]), 5).astype(np.int64)
    assert [B.xorshift_shifts(r.tolist()) for r in out] == [(13, 17, 5)] * 2
    assert B.xorshift_shifts([1, 2]) is None and B.xorshift_shifts([1, 2, 3, 4]) is None


def test_statistics_of_good_and_bad_sequences(spark):
    assert B.statistics(np.full(50, 3.0))["composite"] == 0.5
    good = B.statistics(np.random.default_rng(3).integers(0, 1000, 5000).astype(float))
    assert good["chi2_p"] > 0.001 and good["runs_p"] > 0.001 and abs(good["lag1"]) < 0.05
    bad = B.statistics(np.arange(5000.0))
    assert bad["runs"] == 2 and bad["runs_p"] < 1e-6 and bad["lag1"] > 0.99
    rows = B.exhaustive(spark.range(3).withColumnRenamed("id", "seed"), "minstd", 300).collect()
    x = (G.sequences("minstd", np.array([2]), 300) % np.uint64(1000)).astype(float)[0]
    assert {r.seed for r in rows} == {0, 1, 2} and [r for r in rows if r.seed == 2][0].composite == pytest.approx(B.statistics(x)["composite"])


def test_fallback_order(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5)], "seed long, match_rate double")
    d.write.json(f"{tmp_path}/a.json")
    assert files.load_survivors(spark, f"{tmp_path}/a").first().seed == 1
    d.withColumn("seed", d.seed + 1).write.parquet(f"{tmp_path}/a.parquet")
    assert files.load_survivors(spark, f"{tmp_path}/a").first().seed == 2
    with pytest.raises(FileNotFoundError):
        files.load_survivors(spark, f"{tmp_path}/b")


def test_best_trials_search_their_whole_range(spark, tmp_path):
    """A seed at the very end of a trial's range is found."""
    import pandas as pd

    import __spark_entry__ as entry
    from drawloom.operators import sieve as S

    v = S.planted("minstd", 50_009, [2] * 8)
    n = len(v)
    pd.DataFrame({"event_id": range(n), "value": [x / 100 for x in v], "ts": pd.Timestamp("2025-01-01"), "event_type": "x", "user_id": 1}).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    t = {"id": [1, 2, 3], "prng_type": [" MINSTD", "minstd", "java_lcg_hybrid"], "trial_score": [0.2, 0.9, 1.0], "seed_range_start": [0, 50_000, 0], "seed_range_end": [10, 50_010, 10], "skip_min": [0, 1, 0], "skip_max": [3, 3, 0], "forward_threshold": [0.5, 0.9, 0.1]}
    pd.DataFrame(t).to_parquet(tmp_path / "step1_trial_history.parquet")
    got = entry.queries()["sieve_best_trials"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("minstd", 2, 10, 1, 1.0)]
