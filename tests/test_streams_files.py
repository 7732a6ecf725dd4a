"""Streams against batches, input shapes, tolerant readers."""

import json
import os

from pyspark.sql import functions as F

from drawloom.operators import features, generators
from drawloom.sources import files
from drawloom.streaming import ingest


def test_validation_shapes(spark):
    rows = ['{"draw":[1,2,3],"draw_id":"a"}', '{"value":45,"draw_id":"b"}', '{"digits":[0,0,0],"draw_id":"c"}', '{"draw":[1,10,3]}', '{"draw":[1,2]}', '{"value":1000}', "{}", '{"draw":[1,null,2]}', "torn"]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ingest.RAW).alias("r")).select("r.*")
    assert [(r.draw_id, r.raw_value) for r in ingest.validate(df).where("ok").collect()] == [("a", 123), ("b", 45), ("c", 0)]
    t = spark.createDataFrame([("1 2 3",), ("1,2,3",), ("123",)], "l string")
    assert all(r.d == [1, 2, 3] for r in t.select(ingest.parse_text(F.col("l")).alias("d")).collect())


def test_stream_dedup_and_state_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate([[("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 9, False)], [("a", 3, False), ("a", 4, False)]]):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "n": n, "hit": h}) for k, n, h in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)
    s = spark.readStream.schema("k string, n long, hit boolean").option("maxFilesPerTrigger", 1).json(str(src))
    assert ingest.run_once(ingest.deduplicated(s, "n"), "t").count() == 5
    last = ingest.run_once(ingest.miss_counter(s, "k", "n", "hit"), "m", "update", ["k"]).collect()
    assert {r.k: (r.misses, r.seen) for r in last} == {"a": (3, 5), "b": (1, 1)}


def test_tolerant_readers(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text("[5, 0, 7]")
    b.write_text(json.dumps([{"draw": 0}, {"number": 3}, {"value": 9, "full_state": 1000}, {"x": 1}]))
    assert [r.draw for r in files.tolerant_history(spark, str(a)).orderBy("idx").collect()] == [5, 0, 7]
    assert [r.draw for r in files.tolerant_history(spark, str(b)).orderBy("idx").collect()] == [0, 3, 1000, None]
    s1, s2 = tmp_path / "s1.json", tmp_path / "s2.json"
    s1.write_text(json.dumps([{"seed": 1, "score": 0.1}, {"seed": 2, "score": 0.2}]))
    s2.write_text(json.dumps({"results": [{"survivors": [{"seed": 2, "score": 0.9}]}, {"survivors": [{"seed": 3}]}]}))
    assert {r.seed: r.score for r in files.survivors(spark, [str(s1), str(s2)]).collect()} == {1: 0.1, 2: 0.9, 3: None}
    w = spark.createDataFrame([("7-63",), ("56",), ("x",), (None,)], "s string").select(files.range_width(F.col("s")).alias("w"))
    assert [r.w for r in w.collect()] == [56, 56, None, None]


def test_html_rows(spark):
    h = "<table><tr><th>d</th></tr><tr><td>2025-01-01</td><td>Midday</td><td>0 4 7 Wild 3</td></tr><tr><td>2025-01-01</td><td>Midday</td><td>047</td></tr><tr><td>x</td><td>y</td><td>none</td></tr></table>"
    got = files.draw_table(spark.createDataFrame([(h,), (None,), ("",)], "h string"), "h").collect()
    assert [tuple(r) for r in got] == [("2025-01-01", "midday", 47)]


def test_fingerprint_changes_and_empty(spark):
    d = spark.range(50).selectExpr("CAST(id AS string) AS k")
    f = lambda x: ingest.change_fingerprint(x, "k").first().fingerprint
    assert f(d) == f(d.repartition(3)) != f(d.where("k <> '7'")) and f(d.where("false")) == "00000000"


def test_features_and_reconstruction(spark):
    import numpy as np

    p = np.arange(40)[None, :] % 7
    f = features.feature_matrix(p, p[0], p.astype(generators.U64), 4)
    assert set(f) == set(features.FEATURES) and f["score"][0] == 100 and f["kl_8"][0] == 0 and f["residual_max_abs"][0] == 0
    assert abs(f["autocorr_7"][0]) > 0.7 and features.battery(p[:, :5], p[:, :5].astype(generators.U64))["fft_peak"][0] == 0
    v = [12345]
    for _ in range(6):
        v.append((1103515245 * v[-1] + 12345) % 2147483647)
    assert features.reconstruct_lcg(v, 2147483647) == (1103515245, 12345) and features.reconstruct_lcg([1, 2, 4, 9], 2147483647) is None
    s = spark.range(3000).selectExpr("id AS idx", "CAST(round(100 * sin(2 * pi() * id / 25)) AS double) AS v")
    r = features.dominant_period(s, "v", "idx", block=2048).first()
    assert r.period == 25 and r.confident
