"""Queries of what is put beside survivors, of regimes, and of reports over trials, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.functions.keys import key, key_sql
from drawloom.operators import features as X
from drawloom.operators import generators as G
from drawloom.operators import ranking as R
from drawloom.operators import scoring as C
from drawloom.operators import sieve as S
from drawloom.operators import windows as W
from drawloom.queries.sieve import _BOTH, K, N, SKIPS, T, window_values
from drawloom.sources import files
from drawloom.sources.tables import DRAWS_SQL, draws, table
from drawloom.storage import scratch_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _n():  # noqa: ANN202
    return F.count(F.lit(1))


# ---- the row of global features ---------------------------------------------------------------------------------------

_ENT = "(SELECT -sum((p / s) * ln(p / s)) / ln({m}) FROM (SELECT coalesce(c, 0) / (SELECT count(*) FROM g) + 1e-10 AS p, 1 + {m} * 1e-10 AS s FROM range({m}) r LEFT JOIN (SELECT v % {m} AS k, count(*) AS c FROM g GROUP BY 1) t ON t.k = r.range))"
_MARK = "(SELECT coalesce(stddev_pop(d) / avg(d), 0.0) FROM (SELECT pos - lag(pos) OVER (ORDER BY pos) AS d FROM g WHERE v = {m}))"
_GLOBAL_SQL = f"""g AS (SELECT draw AS v, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS n FROM draws), c AS (SELECT v, count(*) AS c, max(pos) AS last FROM g GROUP BY v),
kl AS (SELECT sum((coalesce(a, 0) + 1) / 2000.0 * ln((coalesce(a, 0) + 1.0) / (coalesce(b, 0) + 1.0))) AS kl FROM range(1000) r LEFT JOIN (SELECT v, count(*) FILTER (pos >= n - 1000) AS a, count(*) FILTER (pos < n - 1000 AND pos >= n - 2000) AS b FROM g GROUP BY v) t ON t.v = r.range),
l AS (SELECT DISTINCT (n - 1 - pos) // least(100, n // 4) AS w, v FROM g WHERE n - 1 - pos < 4 * least(100, n // 4)),
raw AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT max(c) / min(c) FROM c) AS frequency_bias_ratio, {', '.join(f'{_MARK.format(m=m)} AS marker_{m}_variance' for m in (390, 575, 804))},
 (SELECT count(*) FILTER (v IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)) / count(*) / 0.01 FROM g) AS power_of_two_bias, (SELECT kl FROM kl) AS kl, {', '.join(f'{_ENT.format(m=m)} AS residue_{m}_entropy' for m in (8, 125, 1000))},
 (SELECT (1000 - count(*) + count(*) FILTER ((SELECT count(*) FROM g) - 1 - last > 500)) / 1000 FROM c) AS suspicious_gap_percentage, (SELECT count(*) / 3 / 1000 FROM l a JOIN l b ON a.w = b.w - 1 AND a.v = b.v) AS stable),
gl AS (SELECT round(frequency_bias_ratio, 6) AS frequency_bias_ratio, CAST((marker_390_variance > 1)::INT + (marker_575_variance > 1)::INT + (marker_804_variance > 1)::INT AS DOUBLE) AS high_variance_count,
 round(marker_390_variance, 6) AS marker_390_variance, round(marker_575_variance, 6) AS marker_575_variance, round(marker_804_variance, 6) AS marker_804_variance, round(power_of_two_bias, 6) AS power_of_two_bias,
 CASE WHEN n >= 2000 AND kl <= 0.15 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS regime_age, CASE WHEN n >= 2000 AND kl > 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_change_detected,
 round(((marker_390_variance > 1)::INT + (marker_575_variance > 1)::INT + (marker_804_variance > 1)::INT) / 3, 6) AS reseed_probability, round(residue_1000_entropy, 6) AS residue_1000_entropy, round(residue_125_entropy, 6) AS residue_125_entropy,
 round(residue_8_entropy, 6) AS residue_8_entropy, round(suspicious_gap_percentage, 6) AS suspicious_gap_percentage, round(stable, 6) AS temporal_stability FROM raw)"""


def _global(spark: SparkSession, folder: str) -> DataFrame:
    return C.global_state(draws(spark, folder)).select(*(F.round(c, 6).alias(c) for c in C.GLOBAL))


@query(f"WITH {DRAWS_SQL}, {_GLOBAL_SQL} SELECT * FROM gl")
def global_features(spark, folder):
    """The 14 features of the whole series in one row."""
    return _global(spark, folder)


TRAIN, HELD = 60, 20


def _held_out(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    v = window_values(spark, folder, TRAIN + HELD)
    return v[:TRAIN], v[TRAIN:]


def _survivors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pass_ = lambda r: S.fixed_skip(S.seed_space(spark, 0, N), window_values(spark, folder, K), "java_lcg", SKIPS, T, reverse=r)
    return pass_(False), pass_(True)


_HELD = ", ".join(f"({p - 1 - TRAIN}, {a}, {c})" for p, (a, c) in G.jumps(G.FAMILIES["java_lcg"].affine, list(range(TRAIN + 1, TRAIN + HELD + 1))).items())
_HITS_SQL = f"""h(i, a, c) AS (VALUES {_HELD}), hits AS (SELECT f.seed, avg(CAST(((CAST(((CAST(f.seed AS HUGEINT) * h.a + h.c) % 281474976710656) AS BIGINT) >> 16) & 4294967295) % 1000 = d.draw AS INT)) AS holdout_hits FROM f, h JOIN draws d ON d.idx = h.i + {TRAIN} GROUP BY f.seed)"""


@query(f"{_BOTH}, {_HITS_SQL} SELECT seed, round(holdout_hits, 6) AS holdout_hits FROM hits")
def holdout_hits(spark, folder):
    """Share of the values after the training ones that each survivor's outputs hit."""
    f, _ = _survivors(spark, folder)
    return C.holdout_hits(f, _held_out(spark, folder)[1], "java_lcg", TRAIN).select("seed", F.round("holdout_hits", 6).alias("holdout_hits"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors with the counts of their trial where both passes have them, features, hits on held-out values and global features."""
    f, r = _survivors(spark, folder)
    counts = S.trial_summary(f, r).withColumn("intersection_count", F.col("bidirectional_count")).withColumn("skip_min", F.lit(SKIPS[0])).withColumn("skip_max", F.lit(SKIPS[1])).withColumn("skip_range", F.lit(SKIPS[1] - SKIPS[0]))
    meta = f.select("seed").join(r.select("seed"), "seed").crossJoin(F.broadcast(counts))
    train, held = _held_out(spark, folder)
    x = X.seed_features(f.select("seed"), train, "java_lcg").join(C.holdout_hits(f, held, "java_lcg", TRAIN), "seed")
    return C.with_global(C.with_metadata(x, meta, C.METADATA), _global(spark, folder))


@query()
def scored_survivors(spark, folder):
    """The full row of every survivor: features, metadata, held-out hits, global features."""
    return _scored(spark, folder)


@query(f"""{_BOTH}, {_HITS_SQL}, {_GLOBAL_SQL}, k AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM f SEMI JOIN r USING (seed)) AS nb)
SELECT f.seed, round(hits.holdout_hits, 6) AS holdout_hits, CASE WHEN r.seed IS NULL THEN 0.0 ELSE CAST(k.nf AS DOUBLE) END AS forward_count, CASE WHEN r.seed IS NULL THEN 0.0 ELSE CAST(k.nf - k.nb AS DOUBLE) END AS forward_only_count,
 CASE WHEN r.seed IS NULL THEN 0.0 ELSE round(k.nb / (k.nf + k.nr - k.nb), 6) END AS intersection_ratio, CASE WHEN r.seed IS NULL THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS skip_range, 0.0::DOUBLE AS skip_entropy, gl.residue_8_entropy AS global_residue_8_entropy, gl.regime_age AS global_regime_age
FROM f JOIN hits USING (seed) LEFT JOIN r USING (seed) CROSS JOIN k CROSS JOIN gl""")
def scored_survivor_columns(spark, folder):
    """Columns of the full row that SQL can say as well."""
    cols = ["seed", "holdout_hits", "forward_count", "forward_only_count", "intersection_ratio", "skip_range", "skip_entropy", "global_residue_8_entropy", "global_regime_age"]
    return _scored(spark, folder).select(*cols).withColumns({c: F.round(c, 6) for c in ("holdout_hits", "intersection_ratio")})


@query(f"""WITH m AS (SELECT seed, min(CASE WHEN isnan(chi2_score) THEN NULL ELSE chi2_score END) AS chi2, max(samples) AS samples FROM (SELECT DISTINCT ON (id) * FROM cache_results) WHERE {key_sql('prng_type')} = 'java_lcg' AND seed IS NOT NULL GROUP BY seed)
SELECT s.seed, coalesce(m.chi2, 0.0) AS chi2, coalesce(CAST(m.samples AS DOUBLE), 0.0) AS samples, 0.0::DOUBLE AS absent FROM (SELECT DISTINCT seed FROM cache_results WHERE seed IS NOT NULL) s LEFT JOIN m USING (seed)""")
def metadata_lookup(spark, folder):
    """Every cached seed with what one generator's results say of it, 0 where they say nothing."""
    r = table(spark, folder, "cache_results").select("id", "seed", "prng_type", "chi2_score", "samples").where("seed IS NOT NULL")
    own = r.where(key("prng_type") == "java_lcg").groupBy("seed").agg(F.min(F.when(~F.isnan("chi2_score"), F.col("chi2_score"))).alias("chi2"), F.max("samples").alias("samples"))
    return C.with_metadata(r.select("seed").distinct(), own, ["chi2", "samples", "absent"])


# ---- regimes ---------------------------------------------------------------------------------------------------------


def _density_sql(sizes: list[int], name: str) -> str:
    vals = ", ".join(f"({s})" for s in sizes)
    return f"""{name}_w AS (SELECT z.s AS size, k.range AS win, k.range * greatest(1, ((SELECT count(*) FROM draws) - z.s) // 20) AS at FROM (VALUES {vals}) z(s), range(20) k WHERE (SELECT count(*) FROM draws) >= 2 * z.s),
{name}_r AS (SELECT w.size, w.win, m.m, d.draw % m.m AS r, count(*) AS c FROM {name}_w w JOIN draws d ON d.idx >= w.at AND d.idx < w.at + w.size CROSS JOIN (VALUES (8), (125)) m(m) WHERE w.at < (SELECT count(*) FROM draws) - w.size GROUP BY ALL),
{name}_x AS (SELECT size, win, m, any_value(m) * sum(c * c) / sum(c) - sum(c) AS x FROM {name}_r GROUP BY size, win, m), {name}_c AS (SELECT size, win, sum(CASE WHEN m = 8 THEN x WHEN size >= 50 THEN x * 0.1 ELSE 0 END) AS chi FROM {name}_x GROUP BY size, win),
{name} AS (SELECT z.s AS size, coalesce(d, 0.0) AS density FROM (VALUES {vals}) z(s) LEFT JOIN (SELECT size, round(tanh(avg(chi) / (any_value(size) * 2.0)), 4) AS d FROM {name}_c GROUP BY size) t ON t.size = z.s)"""


@query(f"""WITH {DRAWS_SQL}, {_density_sql([3, 8, 31, 64], 'dn')}, p AS (SELECT max(density) FILTER (size = 3) AS w3, max(density) FILTER (size = 8) AS w8, max(density) FILTER (size = 31) AS w31, max(density) FILTER (size = 64) AS w64, greatest(max(density), 1e-9) AS t FROM dn),
q AS (SELECT *, round(least(w3 / t, w8 / t) - greatest(w31 / t, w64 / t), 4) AS duality FROM p)
SELECT w3, w8, w31, w64, duality, round(w3 / (w8 + 1e-9), 4) AS ratio, CASE WHEN w3 / t > {C.HIGH} AND w8 / t > {C.HIGH} AND w31 / t < {C.LOW} AND w64 / t < {C.LOW} THEN 'short_persistence' WHEN w31 / t > {C.MIDDLE} OR w64 / t > {C.MIDDLE} THEN 'long_persistence' ELSE 'unknown' END AS regime_type, round(1 / (1 + exp(-duality * 6)), 4) AS confidence FROM q""")
def regime_type(spark, folder):
    """The type of the present regime from the densities of four window sizes."""
    return C.regime_type(draws(spark, folder))


@query(f"""WITH {DRAWS_SQL}, g AS (SELECT abs(draw - lag(draw) OVER (ORDER BY idx)) % 1000 AS g FROM draws), p AS (SELECT g, count(*) AS c FROM g WHERE g IS NOT NULL GROUP BY g), e AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM p)
SELECT round((SELECT h FROM e), 6) AS entropy, round(avg(g), 3) AS mean, round(stddev_pop(g), 3) AS sd, CAST(trunc(quantile_cont(g, 0.05)) AS INTEGER) AS lo, CAST(trunc(quantile_cont(g, 0.95)) AS INTEGER) AS hi, trunc(quantile_cont(g, 0.05)) <= 56 AND trunc(quantile_cont(g, 0.95)) >= 5 AS consistent FROM g WHERE g IS NOT NULL""")
def skip_entropy(spark, folder):
    """Entropy and range of the distances between neighbours."""
    return C.skip_entropy(draws(spark, folder))


@query(f"""WITH {DRAWS_SQL}, {_density_sql([8], 'dn')}, s AS (SELECT t.range AS trial, draw, row_number() OVER (PARTITION BY t.range ORDER BY CAST('0x' || substr(md5(t.range || ':' || idx), 1, 15) AS BIGINT), idx) - 1 AS r FROM draws, range(20) t QUALIFY r < 160),
c AS (SELECT trial, r // 8 AS win, draw % 8 AS k, count(*) AS c FROM s GROUP BY ALL), x AS (SELECT trial, win, 8 * sum(c * c) / sum(c) - sum(c) AS chi FROM c GROUP BY trial, win), d AS (SELECT trial, round(tanh(avg(chi) / 16.0), 4) AS d FROM x GROUP BY trial),
a AS (SELECT (SELECT density FROM dn) AS real, avg(d) AS m, stddev_pop(d) AS sd FROM d)
SELECT 8 AS size, real, round(m, 4) AS shuffled_mean, round(sd, 4) AS shuffled_sd, round(real / (m + 1e-9), 3) AS ratio, round((real - m) / (sd + 1e-9), 2) AS z, CASE WHEN real / (m + 1e-9) > 2 AND (real - m) / (sd + 1e-9) > 3 THEN 'real' WHEN real / (m + 1e-9) > 1.3 AND (real - m) / (sd + 1e-9) > 1.5 THEN 'weak' ELSE 'artifact' END AS verdict FROM a""")
def shuffle_test(spark, folder):
    """Whether the density of windows of eight survives shuffling the series."""
    return C.shuffle_test(draws(spark, folder), 8)


@query(f"WITH {DRAWS_SQL}, s AS (SELECT draw % 3 AS regime, avg(draw % 8) AS x, avg(draw % 125) AS y FROM draws WHERE idx % 2 = 0 GROUP BY 1), t AS (SELECT draw % 3 AS regime, avg(draw % 8) AS x, avg(draw % 125) AS y FROM draws WHERE idx % 2 = 1 GROUP BY 1), p AS (SELECT t.regime, s.regime AS same_as, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS d, row_number() OVER (PARTITION BY t.regime ORDER BY sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)), s.regime) AS k FROM s, t) SELECT regime, same_as, round(d, 6) AS distance FROM p WHERE k = 1")
def regime_alignment(spark, folder):
    """Clusters of one half of the series with the nearest ones of the other, by centroid."""
    d = draws(spark, folder)
    half = lambda k: d.where(F.col("idx") % 2 == k).groupBy((F.col("draw") % 3).alias("regime")).agg(F.avg(F.col("draw") % 8).alias("x"), F.avg(F.col("draw") % 125).alias("y"))
    return C.align(half(0), half(1), ["x", "y"]).select("regime", "same_as", F.round("distance", 6).alias("distance"))


_SCALES = [("w200", 0.2, 1, 0.031, True), ("w400", 0.5, 2, 0.022, True), ("w800", 0.3, 2, 0.014, False)]


@query("SELECT 2 AS regime, TRUE AS stable, round(least(1.0, tanh((0.5 * 0.022 + 0.3 * 0.014) / 0.8 * 10) + least(0.15, 4 * 0.02)), 4) AS confidence")
def regime_fusion(spark, folder):
    """The regime over three scales and how sure it is."""
    return C.fuse(spark.createDataFrame(_SCALES, "scale string, weight double, regime int, silhouette double, stable boolean"), "w400", "w800", 4)


@query()
def regime_quality(spark, folder):
    """Windows by regime, on entropies and digit transitions, with the silhouette of the clustering."""
    return X.regimes(X.regime_windows(draws(spark, folder), "draw", 200, 50, digits=True), 4, quality=True)


# ---- reports over trials and attempts -----------------------------------------------------------------------------------


@query("SELECT outcome, count(*) AS jobs, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(sum(coalesce(training_draws, 0) + coalesce(holdout_draws, 0)) AS BIGINT) AS draws FROM (SELECT DISTINCT ON (id) * FROM attempts) GROUP BY outcome")
def job_rollup(spark, folder):
    """Jobs, their seconds and values per outcome; a row delivered twice counts once."""
    a = table(spark, folder, "attempts").select("id", "outcome", "duration_seconds", "training_draws", "holdout_draws").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.groupBy("outcome").agg(_n().alias("jobs"), F.sum("duration_seconds").alias("seconds"), F.sum(zero("training_draws") + zero("holdout_draws")).alias("draws"))


@query("WITH t AS (SELECT DISTINCT ON (id) * FROM step1_trial_history), k AS (SELECT study_name, id, trial_score, row_number() OVER (PARTITION BY study_name ORDER BY trial_score DESC, id) AS n FROM t WHERE study_name IS NOT NULL AND trial_score IS NOT NULL AND NOT isnan(trial_score)) SELECT study_name, id, trial_score FROM k WHERE n = 1")
def dedup_first_best(spark, folder):
    """The best trial of each study; of equals the one that arrived first. An aggregate, so a study of any size is combined on the map side."""
    t = table(spark, folder, "step1_trial_history").where("study_name IS NOT NULL AND trial_score IS NOT NULL AND NOT isnan(trial_score)")
    return t.groupBy("study_name").agg(F.max(F.struct("trial_score", (-F.col("id")).alias("i"))).alias("b")).select("study_name", (-F.col("b.i")).alias("id"), "b.trial_score")


_SWEEP = f"""WITH t AS (SELECT {key_sql('prng_type')} AS g, max(forward_survivors) AS fwd, max(reverse_survivors) AS rev, CAST(sum(bidirectional_survivors) AS BIGINT) AS two FROM (SELECT DISTINCT ON (id) * FROM step1_trial_history) GROUP BY 1),
d AS (SELECT {key_sql('prng_type')} AS g, CAST(sum(duration_seconds) AS BIGINT) AS s FROM (SELECT DISTINCT ON (id) * FROM attempts) GROUP BY 1),
u AS (SELECT 'fewest_survivors' AS section, g, two AS amount, two AS o FROM t WHERE two > 0 UNION ALL SELECT 'forward_top', g, fwd, -fwd FROM t WHERE fwd > 0 UNION ALL SELECT 'reverse_top', g, rev, -rev FROM t WHERE rev > 0 UNION ALL SELECT 'fastest', g, s, s FROM d WHERE s > 0 UNION ALL SELECT 'slowest', g, s, -s FROM d WHERE s > 0)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY o, g) AS INTEGER) AS rank_no, g AS prng_type, amount FROM u WHERE g IS NOT NULL QUALIFY rank_no <= 5"""


@query(_SWEEP)
def sweep_report(spark, folder):
    """Per generator: fewest survivors of both passes, most of each pass, fastest and slowest; the first five of each."""
    t = table(spark, folder, "step1_trial_history").select("id", key("prng_type").alias("g"), "forward_survivors", "reverse_survivors", "bidirectional_survivors").distinct()
    t = t.groupBy("g").agg(F.max("forward_survivors").alias("fwd"), F.max("reverse_survivors").alias("rev"), F.sum("bidirectional_survivors").alias("both"))
    d = table(spark, folder, "attempts").select("id", key("prng_type").alias("g"), "duration_seconds").distinct().groupBy("g").agg(F.sum("duration_seconds").alias("s"))
    x = t.join(d, "g", "full_outer").where("g IS NOT NULL")
    each = F.array(*(F.struct(F.lit(n).alias("section"), F.col(c).alias("amount"), (F.col(c) * s).alias("o")) for n, c, s in (("fewest_survivors", "both", 1), ("forward_top", "fwd", -1), ("reverse_top", "rev", -1), ("fastest", "s", 1), ("slowest", "s", -1))))
    u = x.select("g", F.explode(each).alias("e")).select("g", "e.*").where("amount > 0")
    # one row per generator and section
    return u.withColumn("rank_no", F.row_number().over(Window.partitionBy("section").orderBy("o", "g"))).where("rank_no <= 5").select("section", "rank_no", F.col("g").alias("prng_type"), "amount")


@query("""WITH m AS (SELECT l_linenumber AS model, var_pop(l_discount) AS test_variance, avg(l_tax) AS train_mae, avg(l_tax) * 1.2 AS val_mae, avg(l_discount) AS test_mae, 0.9 AS consistency, 0.8 AS stability, 0.01 * l_linenumber AS p, 0.1 * l_linenumber AS r2 FROM lineitem GROUP BY l_linenumber)
SELECT model, val_mae / train_mae > 1.5 OR test_mae > val_mae * 1.3 OR p > 0.05 AS overfitting, round((test_variance * 10 + 1 / (test_mae + 0.01) * 5 + consistency * 3 + stability * 2 + (1 - p) * 2 + r2 * 10) * CASE WHEN val_mae / train_mae > 1.5 OR test_mae > val_mae * 1.3 OR p > 0.05 THEN 0.5 ELSE 1 END, 6) AS composite FROM m""")
def overfit_composite(spark, folder):
    """A model's score, halved where it is overfitted."""
    m = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("model")).agg(F.var_pop("l_discount").alias("test_variance"), F.avg("l_tax").alias("train_mae"), F.avg("l_discount").alias("test_mae"))
    m = m.select("model", "test_variance", "train_mae", (F.col("train_mae") * 1.2).alias("val_mae"), "test_mae", F.lit(0.9).alias("variance_consistency"), F.lit(0.8).alias("temporal_stability"), (F.col("model") * 0.01).alias("p_value"), (F.col("model") * 0.1).alias("r2"))
    over = R.overfitting(F.col("val_mae") / F.col("train_mae"), F.col("val_mae"), F.col("test_mae"), F.col("p_value"))
    return m.select("model", over.alias("overfitting"), F.round(R.composite(over), 6).alias("composite"))


_HEALTH = """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase' AND user_id % 5 = 0) AS hits, count(*) AS pool, count(DISTINCT user_id) AS survivors FROM events GROUP BY 1),
l AS (SELECT *, round(hits / greatest(pool, 1), 4) AS rate, sum(CAST(hits > 0 AS INT)) OVER (ORDER BY day) AS isl FROM d),
p AS (SELECT *, lag(rate) OVER (ORDER BY day) AS pr, lag(survivors) OVER (ORDER BY day) AS ps, CAST(sum(CAST(hits = 0 AS INT)) OVER (PARTITION BY isl ORDER BY day) AS BIGINT) AS misses FROM l),
h AS (SELECT day, rate AS current_hit_rate, round(CASE WHEN pr > 0 THEN greatest(0, (pr - rate) / pr) ELSE 0 END, 4) AS window_decay, round(CASE WHEN ps > 0 THEN abs(survivors - ps) / ps ELSE 0 END, 4) AS survivor_churn, misses AS consecutive_misses FROM p)
SELECT *, CASE WHEN consecutive_misses >= 5 THEN 'degraded' WHEN consecutive_misses >= 3 OR window_decay > 0.3 THEN 'warning' WHEN survivor_churn > 0.3 THEN 'unstable' ELSE 'stable' END AS model_stability FROM h"""


@query(_HEALTH)
def health_report(spark, folder):
    """Hit rate per day, its decay, how much the survivors changed, misses in a row, and a state. One row per day comes into a window."""
    d = table(spark, folder, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_if((F.col("event_type") == "purchase") & (F.col("user_id") % 5 == 0)).alias("hits"), _n().alias("pool"), F.count_distinct("user_id").alias("survivors"))
    return R.health(d, "day")


@query("WITH s AS (SELECT l_suppkey AS name, sum(l_quantity) FILTER (l_shipdate < DATE '1995-06-01') AS b, sum(l_quantity) FILTER (l_shipdate >= DATE '1995-06-01') AS a FROM lineitem GROUP BY 1), d AS (SELECT name, coalesce(a, 0) - coalesce(b, 0) AS delta FROM s), k AS (SELECT *, row_number() OVER (ORDER BY delta DESC, name) AS g, row_number() OVER (ORDER BY delta, name) AS l FROM d) SELECT 'gainer' AS side, CAST(g AS INTEGER) AS rank_no, name, round(delta, 2) AS delta FROM k WHERE g <= 5 UNION ALL SELECT 'loser', CAST(l AS INTEGER), name, round(delta, 2) FROM k WHERE l <= 5")
def top_movers(spark, folder):
    """The five that gained and the five that lost most between two periods."""
    return R.movers(_periods(spark, folder), "name", 5).withColumn("delta", F.round("delta", 2))


def _periods(spark: SparkSession, folder: str) -> DataFrame:
    li, late = table(spark, folder, "lineitem"), F.col("l_shipdate") >= F.lit("1995-06-01").cast("date")
    part = lambda c: li.where(c).groupBy(F.col("l_suppkey").alias("name")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return R.drift(part(~late), part(late))


@query("WITH s AS (SELECT l_suppkey AS name, sum(l_quantity) FILTER (l_shipdate < DATE '1995-06-01') AS b, sum(l_quantity) FILTER (l_shipdate >= DATE '1995-06-01') AS a FROM lineitem GROUP BY 1), x AS (SELECT name FROM s ORDER BY coalesce(a, 0) DESC, name LIMIT 10), y AS (SELECT name FROM s ORDER BY coalesce(b, 0) DESC, name LIMIT 10) SELECT (SELECT count(*) FROM x WHERE name NOT IN (SELECT name FROM y)) / 10 AS turnover")
def top_turnover(spark, folder):
    """The share of the ten greatest that weren't among the ten greatest before."""
    return R.turnover(_periods(spark, folder), "name", 10)


@query("WITH a AS (SELECT o_custkey AS name, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS name, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1) SELECT a.name, round(a.v - coalesce(b.v, 0), 2) AS delta FROM a LEFT JOIN b USING (name)")
def drift_of_current(spark, folder):
    """Changes of the names that are there now only."""
    o, late = table(spark, folder, "orders"), F.col("o_orderdate") >= F.lit("1996-01-01").cast("date")
    part = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("name")).agg(F.sum("o_totalprice").cast("double").alias("value"))
    return R.drift(part(~late), part(late), current_only=True).select("name", F.round("delta", 2).alias("delta"))


@query("SELECT o_orderkey AS seed, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS score, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END DESC, o_orderkey) - 1 AS pos FROM orders")
def sort_missing_as_zero(spark, folder):
    """Places in the order by score, a missing score as 0, ties by seed: a range-partitioned sort, places counted per partition."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("score"))
    return R.ranked(o, [F.coalesce("score", F.lit(0.0)).desc(), F.col("seed")], "pos")


@query(f"WITH {DRAWS_SQL} SELECT idx, row_number() OVER (ORDER BY date, CASE session WHEN 'midday' THEN 0 WHEN 'evening' THEN 1 ELSE 2 END, idx) - 1 AS pos FROM draws")
def session_order(spark, folder):
    """Places by date, midday before evening before others, then as stored."""
    return R.ranked(draws(spark, folder), [F.col("date"), F.when(F.col("session") == "midday", 0).when(F.col("session") == "evening", 1).otherwise(2), F.col("idx")], "pos").select("idx", "pos")


@query("SELECT o_orderkey AS seed FROM orders ORDER BY CAST('0x' || substr(md5('7:' || o_orderkey), 1, 15) AS BIGINT), o_orderkey LIMIT 500")
def deterministic_sample(spark, folder):
    """500 seeds drawn by a keyed hash: the same for a trial's number, others for another."""
    return R.sample(table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed")), "seed", 7, 500)


@query("""WITH s AS (SELECT o_orderkey AS s, o_orderpriority = '1-URGENT' AS rare, o_custkey % 50 AS trial FROM orders), c AS (SELECT * FROM (VALUES ('usual', 7, 3, 5, 2, 11, 5), ('few', 9973, 1, 9967, 1, 9949, 1), ('many', 3, 2, 4, 3, 5, 4)) c(name, m1, o1, m2, o2, m3, o3)),
v AS (SELECT c.name, s.*, CAST(s.s % m1 < o1 AS INT) + CAST(s.s % m2 < o2 AS INT) + CAST(s.s % m3 < o3 AS INT) >= 2 AS inn FROM s, c), a AS (SELECT name, count(*) FILTER (inn) AS k, count(*) AS n, avg(CAST(rare AS INT)) FILTER (inn) + 1e-6 AS ps, avg(CAST(rare AS INT)) + 1e-6 AS pg, count(DISTINCT trial) FILTER (inn) / count(DISTINCT trial) AS cov FROM v GROUP BY name)
SELECT name, k AS kept, CASE WHEN k < 10 THEN 'too_small' WHEN k / n < 0.01 THEN 'keep_too_low' WHEN k / n > 0.4 THEN 'keep_too_high' ELSE 'ok' END AS reason, CASE WHEN k < 10 OR k / n < 0.01 OR k / n > 0.4 THEN -1.0 ELSE round(greatest(-1, least(1, 0.7 * tanh(ln(ps / pg)) + 0.2 * cov - 0.1 * least(abs(ln((k / n + 1e-9) / 0.1)), 2.0))), 6) END AS objective FROM a""")
def guarded_enrichment(spark, folder):
    """Objectives of three sets of residue tests, with the guards for sets that keep too few or too many."""
    s = table(spark, folder, "orders").select(F.col("o_orderkey").alias("s"), (F.col("o_orderpriority") == "1-URGENT").alias("rare"), (F.col("o_custkey") % 50).alias("trial"))
    c = spark.createDataFrame([("usual", 7, 3, 5, 2, 11, 5), ("few", 9973, 1, 9967, 1, 9949, 1), ("many", 3, 2, 4, 3, 5, 4)], "name string, m1 int, o1 int, m2 int, o2 int, m3 int, o3 int")
    x = s.crossJoin(F.broadcast(c)).withColumn("inn", sum((F.col("s") % F.col(f"m{i}") < F.col(f"o{i}")).cast("int") for i in (1, 2, 3)) >= 2)
    return R.enrichment(x, "name", "inn", "rare", "trial").select("name", "kept", "reason", F.round("objective", 6).alias("objective"))


@query("SELECT l_orderkey AS seed, CAST(min(l_quantity) AS INTEGER) AS skip_min, CAST(max(l_quantity) AS INTEGER) AS skip_max, round(avg(CAST(l_quantity AS INTEGER)), 6) AS skip_mean, round(stddev_pop(CAST(l_quantity AS INTEGER)), 6) AS skip_std, CAST(count(DISTINCT CAST(l_quantity AS INTEGER)) AS INTEGER) AS skip_unique FROM lineitem GROUP BY l_orderkey")
def skip_pattern_statistics(spark, folder):
    """Least, greatest, mean, spread and number of the values of an array of skips."""
    p = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(F.collect_list(F.col("l_quantity").cast("int")).alias("p"))
    return p.select("seed", *R.pattern_statistics("p"))


# ---- files and streams ----------------------------------------------------------------------------------------------------


@query("SELECT 'good' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'error', 8, NULL")
def chunk_scan(spark, folder):
    """Chunks of results, of which some are torn: records and errors counted."""
    path = scratch_path(spark, "chunks")
    o = table(spark, folder, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"))).alias("value"))
    torn = spark.range(8).select(F.concat(F.lit('{"seed": '), F.col("id").cast("string"), F.lit(', "sco')).alias("value"))
    o.unionByName(torn).write.text(path)
    return files.chunks(spark, path, "seed bigint, score double").groupBy("kind").agg(_n().alias("n"), F.sum("seed").alias("total"))


@query("SELECT which, count(*) AS n, CAST(sum(seed * pos) AS BIGINT) AS checked FROM (SELECT which, seed, row_number() OVER (PARTITION BY which ORDER BY seed) - 1 AS pos FROM (SELECT 'forward' AS which, o_orderkey AS seed FROM orders UNION SELECT 'reverse', l_orderkey FROM lineitem WHERE l_quantity > 40 UNION SELECT 'bidirectional', l_orderkey FROM lineitem WHERE l_quantity > 40)) GROUP BY which")
def sorted_survivors(spark, folder):
    """Survivors of both passes and of either, each once, written sorted by seed and read back in order.

    Sums are exact: ``checked`` is a bigint, as in the SQL, unless a sum is beyond 64 bits, where the SQL ends by an error; then it is a decimal(38,0).
    """
    f = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"))
    r = table(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("seed"))
    paths = files.write_survivors(f, r, scratch_path(spark, "survivors"))
    out = None
    for which, path in paths.items():
        d = spark.read.schema("seed bigint").json(path)
        # files in the order of their names hold ascending seeds
        d = R.ranked(d, [F.col("seed")], "pos").select(F.lit(which).alias("which"), "seed", "pos")
        out = d if out is None else out.unionByName(d)
    # three rows at most; written, because the type is told from them
    t = written(out.groupBy("which").agg(_n().alias("n"), F.sum(F.col("seed").cast("decimal(19,0)") * F.col("pos")).alias("checked")), "checked")
    beyond = t.where(F.col("checked").isNotNull() & F.col("checked").try_cast("bigint").isNull())
    return t.withColumn("checked", F.col("checked").cast("bigint")) if beyond.isEmpty() else t


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def append_log(spark, folder):
    """Records appended to a log of JSON lines by a stream, then read."""
    from drawloom.streaming import ingest as I

    s = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return I.append_log(s.select("event_id", "event_type", F.col("ts").cast("string").alias("ts")), "log").groupBy("event_type").agg(_n().alias("n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier", "runs")))
def export_tables(spark, folder):
    """Several tables exported as JSON lines, one folder each, listed from the catalogue of the export."""
    out = files.export(spark, {t: table(spark, folder, t) for t in ("region", "nation", "supplier", "runs")}, scratch_path(spark, "export"))
    parts = None
    for name, path in out.items():
        d = spark.read.text(path).agg(_n().alias("n")).select(F.lit(name).alias("name"), "n")
        parts = d if parts is None else parts.unionByName(d)
    return parts


@query("WITH RECURSIVE g(i, x) AS (SELECT 0, 12345::HUGEINT UNION ALL SELECT i + 1, (x * 25214903917 + 11) % 281474976710656 FROM g WHERE i < 2000) SELECT CAST(i // 4 - 1 AS BIGINT) AS idx, CAST(((CAST(x AS BIGINT) >> 16) & 4294967295) % 1000 AS BIGINT) AS draw FROM g WHERE i > 0 AND i % 4 = 0")
def synthetic_draws(spark, folder):
    """500 values of a known seed, skip 3: four steps a value, any position by jump."""
    return G.synthetic(spark, 12345, 500, 3)


@query("SELECT draw % 10 AS digit, count(*) AS n FROM (WITH RECURSIVE g(i, x) AS (SELECT 0, 777::HUGEINT UNION ALL SELECT i + 1, (x * 25214903917 + 11) % 281474976710656 FROM g WHERE i < 600) SELECT CAST(((CAST(x AS BIGINT) >> 16) & 4294967295) % 1000 AS BIGINT) AS draw FROM g WHERE i > 0) GROUP BY 1")
def synthetic_stream(spark, folder):
    """A stream of synthetic values whose positions are the state, in three batches of 200."""
    from drawloom.streaming import ingest as I

    return I.synthetic(spark, 777, 200, 3).groupBy((F.col("draw") % 10).alias("digit")).agg(_n().alias("n"))


# ---- models ---------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.01).cast("double").alias("label"))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("WITH l AS (SELECT l_quantity, l_discount, l_tax, CAST(l_quantity * 1000 + l_extendedprice * 0.01 AS DOUBLE) AS y FROM lineitem), r AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS best, unnest([pow(corr(l_quantity, y), 2), pow(corr(l_discount, y), 2), pow(corr(l_tax, y), 2)]) AS r2 FROM l) SELECT best, round(r2, 4) AS r2 FROM r ORDER BY r2 DESC, best LIMIT 1")
def best_single_feature(spark, folder):
    """Of three linear models of one feature each the one with the highest R2."""
    return X.choose(X.single_fits(_lines(spark, folder), _FEATURES, "label"), "model", "r2").select(F.col("model").alias("best"), F.round("r2", 4).alias("r2"))


@query()
def model_choice(spark, folder):
    """The best of three kinds of models by cross-validated R2."""
    out = None
    for m in ("linear", "forest", "gbt"):
        r = X.train_and_score(_lines(spark, folder), _FEATURES, "label", m)
        out = r if out is None else out.unionByName(r)
    return X.choose(out, "model", "r2_mean").select("model")


@query("SELECT TRUE AS passed, TRUE AS collapsed")
def shuffled_labels(spark, folder):
    """Whether a model's R2 falls to nothing once the labels are shuffled."""
    return X.shuffled_label_test(_lines(spark, folder), _FEATURES, "label", ["l_orderkey", "l_linenumber"]).select("passed", (F.col("shuffled_r2") < 0.1).alias("collapsed"))


@query("SELECT f AS feature, f = 'l_quantity' AS matters FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) v(f)")
def ablation(spark, folder):
    """Which features a model can't do without."""
    return X.ablation(_lines(spark, folder), _FEATURES, "label").select("feature", (F.col("loss") > 0.05).alias("matters"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, abs(l_quantity * 2.0) AS a, abs(l_discount * -30.0) AS b, abs(l_tax * 5.0) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(a / greatest(a + b + c, 1e-12), 6) AS l_quantity, round(b / greatest(a + b + c, 1e-12), 6) AS l_discount, round(c / greatest(a + b + c, 1e-12), 6) AS l_tax FROM x")
def attribution(spark, folder):
    """Each row's shares of what a linear model says of it, by gradient times input."""
    return X.attribution(_lines(spark, folder), dict(zip(_FEATURES, (2.0, -30.0, 5.0))), ["l_orderkey", "l_linenumber"], 6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
