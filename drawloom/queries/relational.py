"""Queries over stores of results, policies, pools and reports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.functions.keys import key, key_sql
from drawloom.operators import policy as P
from drawloom.operators import ranking as R
from drawloom.operators import registry as S
from drawloom.sources.tables import DRAWS_SQL, draws, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _r(c, d: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, d)




def _cache(spark, folder):  # noqa: ANN001, ANN202
    return table(spark, folder, "cache_results").dropDuplicates(["id"])


@query(f"WITH c AS (SELECT DISTINCT ON (id) * FROM cache_results) SELECT {key_sql('prng_type')} AS prng_type, mapping_type, count(*) AS n, min(CASE WHEN NOT isnan(composite_score) THEN composite_score END) AS best, count(DISTINCT seed) AS seeds FROM c GROUP BY ALL")
def cache_summary(spark, folder):
    """Stored results per generator and mapping."""
    ok = F.when(~F.isnan("composite_score"), F.col("composite_score"))
    return _cache(spark, folder).groupBy(key("prng_type").alias("prng_type"), "mapping_type").agg(F.count(F.lit(1)).alias("n"), F.min(ok).alias("best"), F.count_distinct("seed").alias("seeds"))


@query(f"WITH c AS (SELECT DISTINCT ON (id) * FROM cache_results) SELECT id, seed, composite_score FROM c WHERE composite_score IS NOT NULL AND NOT isnan(composite_score) AND samples >= 5000 AND {key_sql('prng_type')} = 'java_lcg' ORDER BY composite_score, id LIMIT 25")
def best_cached(spark, folder):
    """The lowest scores with their predicates, a top-k."""
    c = _cache(spark, folder).where(F.col("composite_score").isNotNull() & ~F.isnan("composite_score") & (F.col("samples") >= 5000) & (key("prng_type") == "java_lcg"))
    return c.select("id", "seed", "composite_score").orderBy("composite_score", "id").limit(25)


@query("WITH t AS (SELECT DISTINCT ON (id) * FROM step1_trial_history), k AS (SELECT id, run_id, study_name, CASE WHEN isnan(downstream_score) THEN NULL ELSE downstream_score END AS d, CASE WHEN isnan(trial_score) THEN NULL ELSE trial_score END AS t, recorded_at FROM t) SELECT id, study_name, coalesce(d, t) AS best FROM k WHERE coalesce(d, t) IS NOT NULL ORDER BY coalesce(d, t) DESC, recorded_at DESC, id LIMIT 20")
def best_trials(spark, folder):
    """The best trials by downstream score, else their own, newest first among equals."""
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    t = table(spark, folder, "step1_trial_history").dropDuplicates(["id"]).withColumn("best", F.coalesce(nan("downstream_score"), nan("trial_score")))
    return t.where("best IS NOT NULL").orderBy(F.desc("best"), F.desc("recorded_at"), "id").limit(20).select("id", "study_name", "best")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM orders GROUP BY o_orderstatus")
def status_share(spark, folder):
    """Jobs per status with their share."""
    return S.shares(table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query(f"WITH a AS (SELECT DISTINCT ON (id) * FROM attempts) SELECT {key_sql('prng_type')} AS prng_type, count(*) AS attempts, CAST(sum(CASE WHEN outcome = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successes, CAST(sum(CASE WHEN outcome <> 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM a GROUP BY ALL")
def attempts_by_generator(spark, folder):
    """Attempts, successes and failures."""
    a = table(spark, folder, "attempts").dropDuplicates(["id"])
    return a.groupBy(key("prng_type").alias("prng_type")).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("outcome") == "SUCCESS", 1).otherwise(0)).alias("successes"), F.sum(F.when(F.col("outcome") != "SUCCESS", 1).otherwise(0)).alias("failures"))


@query("WITH a AS (SELECT DISTINCT ON (id) * FROM attempts) SELECT outcome, count(*) AS n FROM a WHERE outcome <> 'SUCCESS' GROUP BY outcome ORDER BY n DESC, outcome LIMIT 1")
def most_common_failure(spark, folder):
    """The outcome that fails most."""
    a = table(spark, folder, "attempts").dropDuplicates(["id"]).where("outcome <> 'SUCCESS'")
    return a.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome").limit(1)


@query(f"""WITH a AS (SELECT DISTINCT {key_sql('fingerprint')} AS f, {key_sql('prng_type')} AS p FROM attempts), fs AS (SELECT DISTINCT f FROM a WHERE f IS NOT NULL), ps AS (SELECT DISTINCT p FROM a WHERE p IS NOT NULL)
SELECT f AS fingerprint, (SELECT count(*) FROM ps) - count(p) AS untried FROM a WHERE f IS NOT NULL GROUP BY f""")
def untried_generators(spark, folder):
    """Generators that a fingerprint hasn't been tried with. Counted from what was tried: the anti-joined product is never made."""
    a = table(spark, folder, "attempts").select(key("fingerprint").alias("fingerprint"), key("prng_type").alias("p")).distinct()
    total = a.where("p IS NOT NULL").agg(F.count_distinct("p").alias("t"))
    return a.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("p").alias("c")).crossJoin(F.broadcast(total)).select("fingerprint", (F.col("t") - F.col("c")).alias("untried"))


@query(f"SELECT g.g AS prng_type, coalesce(max(h.seed_range_end), 0) AS next_start FROM (SELECT DISTINCT {key_sql('prng_type')} AS g FROM cache_results) g LEFT JOIN step1_trial_history h ON {key_sql('h.prng_type')} = g.g WHERE g.g IS NOT NULL GROUP BY g.g")
def coverage_watermark(spark, folder):
    """Where the next search of each generator starts."""
    g = table(spark, folder, "cache_results").select(key("prng_type").alias("prng_type")).where("prng_type IS NOT NULL").distinct()
    h = table(spark, folder, "step1_trial_history").select(key("prng_type").alias("prng_type"), "seed_range_end")
    return S.watermark(h, "prng_type", "seed_range_end", g)


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders WHERE o_orderstatus = 'O') SELECT job_id, priority, created_at FROM j WHERE priority >= 3 ORDER BY priority DESC, created_at, job_id LIMIT 30""")
def job_queue(spark, folder):
    """The next jobs by priority, then age."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return S.job_queue(o, 30, least=3).select("job_id", "priority", "created_at")


@query("SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_distinct(spark, folder):
    """Distinct values at a path of a JSON column."""
    return table(spark, folder, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()


@query("WITH p AS (SELECT DISTINCT json_extract_string(parameters, '$.window') AS w, mapping_type FROM cache_results) SELECT w AS window, count(*) AS mappings FROM p GROUP BY w")
def parameter_mappings(spark, folder):
    """Mappings seen per window parameter of the stored JSON."""
    p = table(spark, folder, "cache_results").select(F.get_json_object("parameters", "$.window").alias("window"), "mapping_type").distinct()
    return p.groupBy("window").agg(F.count(F.lit(1)).alias("mappings"))


@query("""WITH n AS (SELECT user_id, max(event_id) AS id FROM events WHERE event_id % 3 = 0 GROUP BY user_id), b AS (SELECT user_id, max(event_id) AS id FROM events WHERE event_id % 3 <> 0 GROUP BY user_id)
SELECT coalesce(n.user_id, b.user_id) AS user_id, coalesce(n.id, b.id) AS event_id FROM n FULL JOIN b USING (user_id)""")
def upsert_latest(spark, folder):
    """INSERT OR REPLACE: new rows win over stored ones, the last of equals among the new."""
    e = table(spark, folder, "events").select("user_id", "event_id")
    store = e.where("event_id % 3 <> 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return S.upsert(store, e.where("event_id % 3 = 0"), ["user_id"], [F.col("event_id")])


@query("WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), n AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT user_id, 'stored' AS origin FROM s UNION ALL SELECT user_id, 'new' FROM n WHERE user_id NOT IN (SELECT user_id FROM s)")
def insert_absent(spark, folder):
    """INSERT OR IGNORE."""
    e = table(spark, folder, "events")
    tag = lambda t, o: e.where(F.col("event_type") == t).select("user_id", F.lit(o).alias("origin")).distinct()
    return S.insert_absent(tag("view", "stored"), tag("purchase", "new"), ["user_id"])


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def time_to_live(spark, folder):
    """What remains after rows older than a week are purged."""
    e = table(spark, folder, "events")
    now = e.agg(F.max("ts").alias("_now"))
    return S.expire(e.crossJoin(F.broadcast(now)), "ts", 7, F.col("_now")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def dimension_join(spark, folder):
    """A chain of joins on small dimensions."""
    r, n, s = (table(spark, folder, x) for x in ("region", "nation", "supplier"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def attempted_semi_join(spark, folder):
    """EXISTS as a semi-join."""
    li = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return table(spark, folder, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT p.p AS prng_type, m.m AS mapping_type FROM (SELECT DISTINCT event_type AS p FROM events) p, (SELECT DISTINCT o_orderstatus AS m FROM orders) m")
def parameter_product(spark, folder):
    """The product of two parameter lists."""
    return table(spark, folder, "events").select(F.col("event_type").alias("prng_type")).distinct().crossJoin(F.broadcast(table(spark, folder, "orders").select(F.col("o_orderstatus").alias("mapping_type")).distinct()))


@query("SELECT l_linestatus AS group_name, l_returnflag AS name, round(sum(l_quantity * (l_discount + 0.01)) / sum(l_discount + 0.01), 6) AS weighted, round(avg(l_quantity), 6) AS uniform, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL")
def weighted_parameters(spark, folder):
    """Weighted and plain means of parameters."""
    q, w = F.col("l_quantity"), F.col("l_discount") + 0.01
    return table(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("group_name"), F.col("l_returnflag").alias("name")).agg(_r(F.sum(q * w) / F.sum(w)).alias("weighted"), _r(F.avg(q)).alias("uniform"), F.min(q).alias("lo"), F.max(q).alias("hi"))


_SURV = "s AS (SELECT o_orderkey AS seed, round(o_totalprice / 1000, 2) AS score, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 97) / 97.0 END AS stability FROM orders)"


def _survivors(spark, folder):  # noqa: ANN001, ANN202
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(k.alias("seed"), F.round(F.col("o_totalprice") / 1000, 2).alias("score"), F.when(k % 17 != 0, (k % 97) / 97.0).alias("stability"))


@query(f"WITH {_SURV} SELECT * FROM s WHERE stability > 0.8")
def policy_filter(spark, folder):
    """Rows that a threshold keeps."""
    return P.apply(_survivors(spark, folder), {"transforms": {"filter": {"field": "stability", "operator": "gt", "threshold": 0.8}}})


@query(f"WITH {_SURV} SELECT * FROM s ORDER BY stability ASC NULLS FIRST, seed LIMIT 60")
def policy_filter_floor(spark, folder):
    """Too few rows pass, so the floor's number of best ones is kept."""
    return P.policy_filter(_survivors(spark, folder), "stability", "lt", -1.0, 60)


@query(f"WITH {_SURV}, b AS (SELECT min(stability) AS lo, max(stability) AS hi FROM s) SELECT seed, round(score * exp(0.5 * (coalesce(stability, lo) - lo) / (hi - lo)), 6) AS score FROM s, b")
def policy_weight(spark, folder):
    """Exponential weights, mask and all."""
    d = P.apply(_survivors(spark, folder), {"transforms": {"weight": {"field": "stability", "method": "exponential", "alpha": 0.5}, "mask": ["stability"]}})
    return d.select("seed", _r(F.col("score")).alias("score"))


@query(f"WITH {_SURV}, k AS (SELECT *, row_number() OVER (ORDER BY seed) - 1 AS p FROM s) SELECT seed, score, stability FROM k WHERE p >= 500 AND p < 900")
def policy_window(spark, folder):
    """Rows by position."""
    return P.policy_window(_survivors(spark, folder), 500, 900)


@query(f"WITH v AS (SELECT o_custkey % 1000 AS number, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS weight FROM orders GROUP BY 1) SELECT number, CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (ORDER BY weight DESC, number) AS INTEGER) AS rank_no FROM v QUALIFY rank_no <= 100")
def weighted_pool(spark, folder):
    """The hundred heaviest numbers."""
    o = table(spark, folder, "orders").withColumn("num", F.col("o_custkey") % 1000)
    p = R.weighted_pool(o, "num", F.col("o_totalprice").cast("decimal(18,2)"), [20, 100])
    return p.select("number", F.col("weight").cast("double").alias("weight"), "rank_no")


@query("WITH v AS (SELECT o_custkey % 1000 AS number, sum(o_totalprice) AS w FROM orders GROUP BY 1), k AS (SELECT w, row_number() OVER (ORDER BY w DESC, number) AS r FROM v) SELECT CAST(p AS INTEGER) AS pool, round(sum(CASE WHEN r <= p THEN w ELSE 0 END) / sum(w), 3) AS coverage FROM k, (VALUES (20), (100), (300)) z(p) GROUP BY p")
def pool_coverage(spark, folder):
    """Share of the weight in the top 20, 100 and 300."""
    return R.coverage(table(spark, folder, "orders").withColumn("num", F.col("o_custkey") % 1000), "num", F.col("o_totalprice"), [20, 100, 300])


_BT = f"WITH {DRAWS_SQL}, t AS (SELECT DISTINCT session, date AS target FROM draws), h AS (SELECT t.session, t.target, d.idx, d.draw, row_number() OVER (PARTITION BY t.session, t.target ORDER BY d.date DESC, d.idx DESC) AS n FROM t JOIN draws d ON d.session = t.session AND d.date < t.target)"


@query(f"{_BT} SELECT session, target, idx, draw FROM h WHERE n <= 30")
def asof_history(spark, folder):
    """The last 30 draws of the session before each day."""
    d = draws(spark, folder)
    return R.trailing_history(d.select("session", "date").distinct(), d, 30)


@query(f"{_BT}, p AS (SELECT session, target, draw, count(*) AS n FROM h WHERE n <= 300 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session, target ORDER BY n DESC, draw) AS r FROM p), a AS (SELECT session, date AS target, draw FROM draws) SELECT k.session, count(*) AS hits FROM k JOIN a USING (session, target, draw) WHERE r <= 100 GROUP BY k.session")
def backtest_pools(spark, folder):
    """Hits of pools of 100 from the last 300 draws, day by day."""
    d = draws(spark, folder)
    h = R.trailing_history(d.select("session", "date").distinct(), d, 300).groupBy("session", "target", "draw").agg(F.count(F.lit(1)).alias("n"))
    k = h.withColumn("r", F.row_number().over(Window.partitionBy("session", "target").orderBy(F.desc("n"), "draw"))).where("r <= 100")
    a = d.select("session", F.col("date").alias("target"), "draw")
    return k.join(a, ["session", "target", "draw"]).groupBy("session").agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH {DRAWS_SQL}, k AS (SELECT date, session, draw, row_number() OVER (PARTITION BY date, session ORDER BY idx) AS n FROM draws) SELECT date, session, draw FROM k WHERE n = 1")
def point_lookup(spark, folder):
    """The first draw of each date and session."""
    return draws(spark, folder).groupBy("date", "session").agg(F.min_by("draw", "idx").alias("draw"))


@query("WITH b AS (SELECT event_type AS name, avg(value) AS v FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' GROUP BY 1), a AS (SELECT event_type AS name, avg(value) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT name, round(coalesce(b.v, 0), 6) AS before, round(coalesce(a.v, 0), 6) AS after, round(coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS delta FROM b FULL JOIN a USING (name)")
def importance_drift(spark, folder):
    """Changes over the union of names."""
    e = table(spark, folder, "events")
    side = lambda m, skip: e.where((F.col("event_id") % 2 == m) & (F.col("event_type") != skip)).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    d = R.drift(side(0, "error"), side(1, "view"))
    return d.select("name", *(_r(F.col(c)).alias(c) for c in ("before", "after", "delta")))


_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS sd, min({f}) AS lo, max({f}) AS hi, count(DISTINCT {f}) AS distinct_values, round(avg(CASE WHEN {f} = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share, round(avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0 END), 6) AS null_share, CASE WHEN count(DISTINCT {f}) <= 1 THEN 'constant' WHEN avg(CASE WHEN {f} = 0 THEN 1.0 ELSE 0 END) > 0.95 THEN 'sparse' ELSE 'ok' END AS flag FROM lineitem" for f in _FEATS))
def variance_report(spark, folder):
    """Spread and gaps of features."""
    v = R.variance_report(table(spark, folder, "lineitem"), _FEATS)
    return v.select("feature", _r(F.col("mean"), 4).alias("mean"), _r(F.col("sd"), 4).alias("sd"), "lo", "hi", "distinct_values", _r(F.col("zero_share")).alias("zero_share"), _r(F.col("null_share")).alias("null_share"), "flag")


@query("SELECT count(DISTINCT value) AS unique_values, round(var_pop(value), 4) AS variance, round(avg(value), 6) AS mean, round(avg(CAST(value <> 0 AS INT)), 6) AS nonzero_share, 'healthy' AS status, TRUE AS prediction_allowed FROM events")
def signal_quality(spark, folder):
    """Whether the event values carry signal."""
    q = R.signal_quality(table(spark, folder, "events"), "value")
    return q.select("unique_values", _r(F.col("variance"), 4).alias("variance"), _r(F.col("mean")).alias("mean"), _r(F.col("nonzero_share")).alias("nonzero_share"), "status", "prediction_allowed")


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS repeated_groups, CAST(max(n) AS BIGINT) AS most FROM g")
def duplicate_audit(spark, folder):
    """Rows that repeat their key."""
    return R.duplicate_audit(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]))
def correlation_scan(spark, folder):
    """Correlations of all feature pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]]
    one = table(spark, folder, "lineitem").agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), _r(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def regression_slope(spark, folder):
    """Closed-form linear trend."""
    return table(spark, folder, "lineitem").agg(_r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), _r(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem), m AS (SELECT avg(y) AS m FROM p) SELECT round(1 - sum((y - f) * (y - f)) / sum((y - m) * (y - m)), 6) AS r2, round(avg(abs(y - f)), 2) AS mae FROM p, m")
def goodness_of_fit(spark, folder):
    """R2 and errors of a prediction."""
    d = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("f"))
    return R.fit(d, "y", "f").select(_r(F.col("r2")).alias("r2"), _r(F.col("mae"), 2).alias("mae"))


@query("WITH k AS (SELECT o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT round(avg(o_totalprice) FILTER (r <= 20), 2) AS top20, round(avg(o_totalprice) FILTER (r <= 100), 2) AS top100, round(avg(o_totalprice) FILTER (r <= 300), 2) AS top300, round(avg(o_totalprice) FILTER (r <= 20) - avg(o_totalprice) FILTER (r <= 300), 2) AS divergence FROM k")
def tier_averages(spark, folder):
    """Means of the best 20, 100 and 300."""
    o = table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(300).select("o_totalprice", "o_orderkey")
    k = o.withColumn("r", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    a = {n: F.avg(F.when(F.col("r") <= n, F.col("o_totalprice"))) for n in (20, 100, 300)}
    return k.agg(*(_r(v, 2).alias(f"top{n}") for n, v in a.items()), _r(a[20] - a[300], 2).alias("divergence"))


@query("WITH e AS (SELECT value / 490.02 AS conf, CAST(event_type = 'purchase' AS INT) AS hit FROM events) SELECT round(avg(conf), 6) AS mean, round(max(conf) - min(conf), 6) AS spread, round(avg(conf) FILTER (hit = 1), 6) AS hit_mean, round(avg(conf) FILTER (hit = 0), 6) AS miss_mean, round(greatest(-1, least(1, (avg(conf) FILTER (hit = 1) - avg(conf) FILTER (hit = 0)) / nullif(max(conf) - min(conf), 0))), 6) AS calibration FROM e")
def calibration(spark, folder):
    """Confidence of hits against misses."""
    e = table(spark, folder, "events").select((F.col("value") / 490.02).alias("c"), (F.col("event_type") == "purchase").alias("hit"))
    h, m, s = F.avg(F.when(F.col("hit"), F.col("c"))), F.avg(F.when(~F.col("hit"), F.col("c"))), F.max("c") - F.min("c")
    return e.agg(_r(F.avg("c")).alias("mean"), _r(s).alias("spread"), _r(h).alias("hit_mean"), _r(m).alias("miss_mean"), _r(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (h - m) / F.nullif(s, F.lit(0.0))))).alias("calibration"))


@query(f"WITH {DRAWS_SQL}, p AS (SELECT idx, draw, (idx * 37) % 1000 AS guess FROM draws) SELECT count(*) FILTER (draw = guess) AS hits, count(*) FILTER (draw <> guess AND abs(draw - guess) <= 5) AS near_hits, round(median(abs(draw - guess)), 2) AS median_distance, min(abs(draw - guess)) AS best FROM p")
def hit_report(spark, folder):
    """Hits, near hits and distances of predictions."""
    d = F.abs(F.col("draw") - F.col("idx") * 37 % 1000)
    return draws(spark, folder).agg(F.count_if(d == 0).alias("hits"), F.count_if((d > 0) & (d <= 5)).alias("near_hits"), _r(F.median(d), 2).alias("median_distance"), F.min(d).alias("best"))


@query("SELECT l_returnflag, count(*) AS n, round(greatest(0, least(1, 0.5 * (0.4 * avg(l_discount) + 0.2 * avg(l_tax) + 0.4 * avg(l_quantity / 50)) + 0.3 * avg(l_tax) + 0.2 * avg(l_discount))), 6) AS quality FROM lineitem GROUP BY l_returnflag")
def holdout_quality(spark, folder):
    """A clamped weighted blend of components."""
    q = 0.5 * (0.4 * F.avg("l_discount") + 0.2 * F.avg("l_tax") + 0.4 * F.avg(F.col("l_quantity") / 50)) + 0.3 * F.avg("l_tax") + 0.2 * F.avg("l_discount")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), _r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).alias("quality"))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.e, b.e) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, neighbour_id) AS r FROM s) SELECT query_id, neighbour_id, CAST(r AS INTEGER) AS rank_no, round(c, 5) AS cosine FROM k WHERE r <= 10""")
def nearest_vectors(spark, folder):
    """The ten most similar vectors to every fiftieth one, against all rows, exactly."""
    e = table(spark, folder, "embeddings")
    n = R.nearest_by_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    return n.select("query_id", "neighbour_id", "rank_no", _r(F.col("cosine"), 5).alias("cosine"))


@query("SELECT source, count(*) AS n, min(md5(coalesce(text, ''))) AS first_digest, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY source")
def text_digests(spark, folder):
    """Digests and lengths of texts per source."""
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("first_digest"), F.max(F.length("text").cast("bigint")).alias("longest"))


@query("SELECT string_agg(c, ',' ORDER BY c) AS names, substr(sha256(string_agg(c, ',' ORDER BY c)), 1, 16) AS schema_hash FROM (VALUES ('l_discount'), ('l_extendedprice'), ('l_quantity'), ('l_tax')) t(c)")
def schema_hash(spark, folder):
    """A contract of feature names."""
    names = ",".join(sorted(_FEATS))
    return spark.range(1).select(F.lit(names).alias("names"), F.substring(F.sha2(F.lit(names), 256), 1, 16).alias("schema_hash"))


@query("SELECT trial_number, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM step1_trial_history) WHERE skip_min BETWEEN 0 AND skip_max AND skip_max <= 100 AND window_size BETWEEN 1 AND 1000 AND forward_threshold BETWEEN 0.01 AND 1 AND reverse_threshold BETWEEN 0.01 AND 1 GROUP BY trial_number")
def valid_configs(spark, folder):
    """Trials whose configuration lies within the bounds; a repeated id counts once."""
    t = table(spark, folder, "step1_trial_history").select("id", "trial_number", "skip_min", "skip_max", "window_size", "forward_threshold", "reverse_threshold").dropDuplicates(["id"])
    b = lambda c, lo, hi: F.col(c).between(lo, hi)
    ok = (F.col("skip_min") >= 0) & (F.col("skip_min") <= F.col("skip_max")) & (F.col("skip_max") <= 100) & b("window_size", 1, 1000) & b("forward_threshold", 0.01, 1) & b("reverse_threshold", 0.01, 1)
    return t.where(ok).groupBy("trial_number").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT DISTINCT ON (id) id, study_name, trial_number, CASE WHEN isnan(trial_score) THEN NULL ELSE trial_score END AS s FROM step1_trial_history) SELECT id, max(s) OVER (PARTITION BY study_name ORDER BY trial_number, id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM t WHERE study_name IS NOT NULL")
def best_so_far(spark, folder):
    """The running best of each study."""
    t = table(spark, folder, "step1_trial_history").dropDuplicates(["id"]).where("study_name IS NOT NULL")
    w = Window.partitionBy("study_name").orderBy("trial_number", "id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("id", F.max(F.when(~F.isnan("trial_score"), F.col("trial_score"))).over(w).alias("best_so_far"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
