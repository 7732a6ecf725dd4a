"""Queries over streams, files, features and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators import features as X
from drawloom.operators import generators as G
from drawloom.operators import sieve as S
from drawloom.queries.sieve import window_values
from drawloom.sources import files
from drawloom.sources.tables import DRAWS_SQL, draws, table
from drawloom.storage import scratch_path
from drawloom.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of files."""
    s = table(spark, folder, "events").schema
    return spark.readStream.schema(s).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, folder):
    """Tumbling windows with a watermark, by a stream over the table's files."""
    s = _event_stream(spark, folder).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return I.run_once(s, "hourly", "complete").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_dedup(spark, folder):
    """Idempotent append: each id once."""
    s = I.deduplicated(_event_stream(spark, folder).select("event_type", "user_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("draw_id"), "ts"))
    return I.run_once(s, "dedup").groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query("""WITH m AS (SELECT event_type, event_id, CAST(user_id % 7 = 0 AS INT) AS hit FROM events), l AS (SELECT event_type, coalesce(max(CASE WHEN hit = 1 THEN event_id END), -1) AS last_hit, count(*) AS seen FROM m GROUP BY event_type)
SELECT l.event_type, count(m.event_id) AS misses, any_value(l.seen) AS seen FROM l LEFT JOIN m ON m.event_type = l.event_type AND m.event_id > l.last_hit GROUP BY l.event_type""")
def stream_misses(spark, folder):
    """Consecutive misses as state between batches."""
    s = _event_stream(spark, folder).select("event_type", "event_id", (F.col("user_id") % 7 == 0).alias("hit"))
    c = I.miss_counter(s, "event_type", "event_id", "hit")
    return I.run_once(c, "misses", "update", ["event_type"]).select("event_type", "misses", "seen")


@query("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS new FROM events), s AS (SELECT user_id, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e),
g AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY user_id""")
def user_sessions(spark, folder):
    """Session windows of 30 minutes."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # a gap of exactly 30 minutes still belongs to the session
    s = e.groupBy("user_id", F.session_window("ts", "1800 seconds 1 microsecond")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query(f"WITH {DRAWS_SQL}, g AS (SELECT idx, draw, CASE WHEN idx % 11 = 0 THEN 'bad' ELSE 'good' END AS kind FROM draws) SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'good' THEN draw END) AS BIGINT) AS total FROM g GROUP BY kind")
def ingest_validation(spark, folder):
    """Files of three shapes, written, read as a stream, validated and quarantined."""
    path = scratch_path(spark, "raw")
    d, bad = draws(spark, folder), F.col("idx") % 11 == 0
    digits = F.array(F.floor(F.col("draw") / 100) % 10, F.floor(F.col("draw") / 10) % 10, F.col("draw") % 10)
    d.select(
        F.when(bad, F.array(F.lit(1), F.lit(10), F.lit(3))).when(F.col("idx") % 3 == 0, digits.cast("array<int>")).alias("draw"), F.when(~bad & (F.col("idx") % 3 == 1), F.col("draw").cast("int")).alias("value"),
        F.when(~bad & (F.col("idx") % 3 == 2), digits.cast("array<int>")).alias("digits"), F.col("idx").cast("string").alias("draw_id"), F.col("date").cast("string").alias("timestamp"),
    ).write.json(path)
    v = I.run_once(I.validate(I.read_raw(spark, path)), "valid")
    good, wrong = I.quarantined(v)
    tag = lambda x, k: x.select(F.lit(k).alias("kind"), F.col("raw_value").cast("bigint").alias("v"))
    return tag(good, "good").unionByName(tag(wrong, "bad")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN (o_orderkey % 100) / 100.0 < 0.3 THEN 'REGIME_SHIFT' WHEN (o_orderkey % 37) / 37.0 < 0.05 THEN 'HIT_RATE_COLLAPSE' WHEN o_orderkey % 13 >= 10 THEN 'CONSECUTIVE_MISSES' WHEN (o_orderkey % 29) / 29.0 > 0.75 THEN 'CONFIDENCE_DRIFT' WHEN o_orderkey % 150 >= 100 THEN 'N_DRAWS' END AS trigger FROM orders""")
def trigger_priority(spark, folder):
    """Which retraining trigger fires first."""
    k = F.col("o_orderkey")
    t = I.trigger((k % 100) / 100.0, (k % 37) / 37.0, k % 13, (k % 29) / 29.0 - 0.5, k % 150, F.when(k % 50 == 0, 1).otherwise(0))
    return table(spark, folder, "orders").select(k.alias("id"), t.alias("trigger"))


@query("SELECT o_orderkey AS id, list_aggregate(list_sort(list_filter([CASE WHEN o_totalprice > 400000 THEN 'LARGE' END, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' END, CASE WHEN o_orderkey % 2 = 0 THEN 'EVEN' END], lambda x: x IS NOT NULL)), 'string_agg', ',') AS flags, (o_totalprice / 500000 >= 0.6) AND (o_orderkey % 5 <= 3) AS accepted FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'F' OR o_orderkey % 2 = 0")
def summary_flags(spark, folder):
    """Names of the rules that hold, and whether a proposal passes review."""
    o = table(spark, folder, "orders")
    f = I.flags({"LARGE": F.col("o_totalprice") > 400000, "CLOSED": F.col("o_orderstatus") == "F", "EVEN": F.col("o_orderkey") % 2 == 0})
    changes = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(F.col("o_orderkey") % 5 <= 3, 0.1).otherwise(0.5))
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws(",", f).alias("flags"), I.accepted(F.col("o_totalprice") / 500000, changes).alias("accepted")).where("flags <> ''")


@query(f"WITH {DRAWS_SQL}, h AS (SELECT CAST('0x' || substr(md5(CAST(idx AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM draws) SELECT substr(sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(h) AS VARCHAR) || ':' || CAST(bit_xor(h) AS VARCHAR)), 1, 8) AS fingerprint, count(*) AS n FROM h")
def history_fingerprint(spark, folder):
    """A digest that changes with any row of the history."""
    return I.change_fingerprint(draws(spark, folder).select(F.concat_ws("|", F.col("idx").cast("string"), F.col("draw").cast("string")).alias("k")), "k")


@query("SELECT o_orderkey AS seed, o_totalprice AS score, o_orderstatus AS prng_type FROM orders")
def sink_round_trip(spark, folder):
    """A result in several formats, read back from JSON lines."""
    d = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("prng_type"))
    out = files.write_results(d, scratch_path(spark, "results"), "score")
    return spark.read.schema(d.schema).json(out["json"])


@query("SELECT count(*) AS rows, 'F,O,P' AS codes, 'seed,score,prng_type' AS columns FROM orders")
def sink_metadata(spark, folder):
    """What is written beside a table."""
    d = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("prng_type"))
    return files.metadata(d, ["prng_type"]).select("rows", F.concat_ws(",", "codes_prng_type").alias("codes"), "columns")


@query(f"WITH {DRAWS_SQL} SELECT CAST(date AS VARCHAR) AS date, session, CAST(draw AS INTEGER) AS draw FROM draws GROUP BY ALL")
def html_scan(spark, folder):
    """Draws from HTML tables, exact repeats once."""
    row = F.concat(F.lit("<tr><td>"), F.col("date").cast("string"), F.lit("</td><td>"), F.initcap("session"), F.lit("</td><td>"), F.lpad(F.col("draw").cast("string"), 3, "0"), F.lit(" Wild 7</td></tr>"))
    pages = draws(spark, folder).groupBy("date").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    return files.draw_table(pages, "html")


@query()
def seed_features(spark, folder):
    """The feature row of every survivor of the sieve, against 60 values."""
    v = window_values(spark, folder, 60)
    s = S.fixed_skip(S.seed_space(spark, 0, 30_000), v[:8], "java_lcg", (0, 4), 1 / 8)
    return X.seed_features(s, v, "java_lcg")


@query(f"WITH {DRAWS_SQL}, st(i, a, c) AS (VALUES " + ", ".join(f"({p - 1}, {a}, {c})" for p, (a, c) in G.jumps(G.FAMILIES["java_lcg"].affine, list(range(1, 61))).items()) + """), p AS (SELECT s.range AS seed, d.draw AS a, ((CAST(((CAST(s.range AS HUGEINT) * st.a + st.c) % 281474976710656) AS BIGINT) >> 16) & 4294967295) % 1000 AS p FROM range(30000) s, st JOIN draws d ON d.idx = st.i)
SELECT seed, round(100 * avg(CAST(p = a AS INT)), 6) AS score, round(avg(CAST(p % 8 = a % 8 AS INT)), 6) AS lane_agreement_8, round(avg(p), 6) AS pred_mean, round(stddev_samp(p), 6) AS pred_std, round(avg(p - a), 6) AS residual_mean, CAST(max(abs(p - a)) AS DOUBLE) AS residual_max_abs, round(avg(CAST(p // 100 = a // 100 AS INT)), 6) AS hundreds_agreement FROM p GROUP BY seed""")
def seed_feature_columns(spark, folder):
    """Feature columns that SQL can say as well."""
    f = X.seed_features(S.seed_space(spark, 0, 30_000), window_values(spark, folder, 60), "java_lcg")
    cols = ["score", "lane_agreement_8", "pred_mean", "pred_std", "residual_mean", "residual_max_abs", "hundreds_agreement"]
    return f.select("seed", *(F.round(c, 6).alias(c) for c in cols))


@query()
def dominant_period(spark, folder):
    """The strongest period of the draws."""
    return X.dominant_period(draws(spark, folder), "draw", "idx")


@query()
def regime_clusters(spark, folder):
    """Windows by regime."""
    return X.regimes(X.regime_windows(draws(spark, folder), "draw", 200, 50), 4)


@query()
def model_scores(spark, folder):
    """Cross-validated fit of three kinds of models."""
    d = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    out = None
    for m in ("linear", "forest", "gbt"):
        r = X.train_and_score(d, ["l_quantity", "l_discount", "l_tax"], "label", m)
        out = r if out is None else out.unionByName(r)
    return out


@query()
def permutation_importance(spark, folder):
    """Which features a model leans on."""
    d = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    return X.permutation_importance(d, ["l_quantity", "l_discount", "l_tax"], "label")


@query(f"SELECT range AS seed, TRUE AS found, CAST(48271 AS BIGINT) AS a, CAST(0 AS BIGINT) AS c FROM range(1, 301)")
def parameter_reconstruction(spark, folder):
    """Parameters of a generator from six outputs of each of 300 seeds."""
    s = G.with_sequence(spark.range(1, 301).withColumnRenamed("id", "seed"), "minstd", "seed", 6).select("seed", F.posexplode("outputs").alias("i", "v"))
    return X.reconstruct(s, "seed", "i", "v", 2147483647).select("seed", "found", "a", "c")


@query()
def generator_sequences(spark, folder):
    """First outputs of every family for the order keys."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"))
    out = None
    for f in G.FAMILIES:
        d = G.with_sequence(o, f, "seed", 4, mod=1000).select(F.lit(f).alias("family"), "seed", "outputs")
        out = d if out is None else out.unionByName(d)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

