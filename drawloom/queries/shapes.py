"""Queries of record shapes in files, of divergences, of generators' parameters and of sieves over the trials' own ranges, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions import stats
from drawloom.functions.keys import key
from drawloom.operators import generators as G
from drawloom.operators import policy as P
from drawloom.operators import reconstruct as B
from drawloom.operators import sieve as S
from drawloom.queries.sieve import HYBRID_N, K, N, PLANTED, SAME, SKIPS, VARYING, window_values
from drawloom.sources import files
from drawloom.sources.tables import DRAWS_SQL, draws, table
from drawloom.storage import scratch_path

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


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, CAST(n_nationkey AS BIGINT) AS draw FROM nation")
def history_shapes(spark, folder):
    """A history of numbers and of objects under four names, read back; 0 is a value."""
    path, k = scratch_path(spark, "history"), F.col("n_nationkey").cast("string")
    item = F.when(F.col("n_nationkey") % 5 == 0, k)
    for i, name in enumerate(("draw", "number", "value", "result"), 1):
        item = item.when(F.col("n_nationkey") % 5 == i, F.concat(F.lit(f'{{"{name}": '), k, F.lit("}")))
    one = table(spark, folder, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("v")))).alias("a"))  # 25 nations
    one.select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["v"]), ","), F.lit("]")).alias("value")).write.text(path)
    return files.tolerant_history(spark, path)


def _chunked(df: DataFrame) -> DataFrame:
    """Survivors in chunks of a thousand keys."""
    return df.groupBy(F.floor(F.col("seed") / 1000).alias("c")).agg(F.collect_list(F.struct("seed", "match_rate")).alias("survivors")).drop("c")


@query("SELECT o_orderkey AS seed, CASE WHEN o_orderkey % 4 < 2 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS match_rate FROM orders")
def survivor_files(spark, folder):
    """Survivors in two shapes of files; of a seed that several files have the last file's record counts."""
    o, path = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed")), scratch_path(spark, "shapes")
    first = _chunked(o.withColumn("match_rate", F.lit(0.5)))
    first.select(F.array(F.struct("survivors")).alias("results")).write.json(f"{path}/a")
    _chunked(o.where("seed % 4 < 2").withColumn("match_rate", F.lit(0.75))).write.json(f"{path}/b")
    return files.survivors(spark, f"{path}/*", lines=True).select("seed", "match_rate")


@query("SELECT 'columns' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM orders WHERE o_orderkey % 2 = 0")
def survivor_sources(spark, folder):
    """Survivors are read from columns where they are there, else from lines."""
    o, path = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), F.lit(0.5).alias("match_rate")), scratch_path(spark, "sources")
    o.write.parquet(f"{path}/x.parquet")
    o.limit(1).write.json(f"{path}/x.json")
    o.where("seed % 2 = 0").write.json(f"{path}/y.json")
    a, b = (files.load_survivors(spark, f"{path}/{n}") for n in "xy")
    return a.agg(_n().alias("n")).select(F.lit("columns").alias("source"), "n").unionByName(b.agg(_n().alias("n")).select(F.lit("lines").alias("source"), "n"))


@query("SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS content FROM orders UNION ALL SELECT 'best', CAST(max(o_orderkey) AS VARCHAR) FROM orders UNION ALL SELECT 'config', '{\"threshold\":0.5}'")
def result_summary(spark, folder):
    """The text summary and the configuration that are written beside a result."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seed"), F.col("o_orderkey").cast("double").alias("score"))
    out = files.write_summary(o, scratch_path(spark, "summary"), "score", "seed", {"threshold": 0.5})
    t = spark.read.text(out["summary"]).select(F.split("value", ": ").alias("p")).select(F.col("p")[0].alias("item"), F.col("p")[1].alias("content"))
    return t.unionByName(spark.read.text(out["config"]).select(F.lit("config").alias("item"), F.col("value").alias("content")))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def feature_exclusion(spark, folder):
    """Columns that would leak the label are left out; names that aren't there don't matter."""
    return P.policy_mask(table(spark, folder, "supplier"), ["s_name", "s_address", "s_phone", "s_acctbal", "s_comment", "not_there"])


@query("SELECT name FROM (VALUES ('drawloom_nation'), ('drawloom_region')) v(name)")
def table_catalogue(spark, folder):
    """The tables that are registered."""
    for t in ("nation", "region"):
        table(spark, folder, t).createOrReplaceTempView(f"drawloom_{t}")
    names = [(t.name,) for t in spark.catalog.listTables() if t.name.startswith("drawloom_")]
    return spark.createDataFrame(names, "name string")


@query(f"""WITH {DRAWS_SQL}, c AS (SELECT range AS r, (SELECT count(*) FROM draws WHERE draw % 8 = range AND idx % 2 = 0) AS a, (SELECT count(*) FROM draws WHERE draw % 8 = range AND idx % 2 = 1) AS b FROM range(8)),
p AS (SELECT *, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q, (a + 1) / (sum(a) OVER () + 8) AS p1, (b + 1) / (sum(b) OVER () + 8) AS q1, greatest(a / sum(a) OVER (), 1e-10) AS pc, greatest(b / sum(b) OVER (), 1e-10) AS qc FROM c), s AS (SELECT *, sum(pc) OVER () AS ps, sum(qc) OVER () AS qs FROM p)
SELECT round(sum(pc / ps * ln((pc / ps) / (qc / qs))), 9) AS renormalised, round(sum(pc * ln(pc / qc)), 9) AS clamped, round(sum(p1 * ln(p1 / q1)), 9) AS add_one, round(sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))), 9) AS epsilon FROM s""")
def divergence_forms(spark, folder):
    """The divergence of residues of even and odd places in its four forms."""
    c = draws(spark, folder).groupBy((F.col("draw") % 8).alias("r")).agg(F.sum((F.col("idx") % 2 == 0).cast("int")).alias("a"), F.sum((F.col("idx") % 2 == 1).cast("int")).alias("b"))
    every = spark.range(8).select(F.col("id").alias("r")).join(c, "r", "left").select("r", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return stats.divergences(every, "a", "b", 8).select(*(F.round(x, 9).alias(x) for x in ("renormalised", "clamped", "add_one", "epsilon")))


@query(f"SELECT * FROM (VALUES ('constant', CAST({PLANTED} AS BIGINT), 1.0::DOUBLE), ('variable', CAST({PLANTED} AS BIGINT), 1.0::DOUBLE)) v(skip_mode, seed, match_rate)")
def skip_mode_union(spark, folder):
    """Results of constant and of varying skips, tagged."""
    a = S.fixed_skip(S.seed_space(spark, 0, N), S.planted("java_lcg", PLANTED, SAME), "java_lcg", SKIPS, 1.0)
    b = S.hybrid(S.seed_space(spark, 0, HYBRID_N), S.planted("java_lcg", PLANTED, VARYING, hybrid=True), "java_lcg", 1.0)
    tag = lambda d, m: d.select(F.lit(m).alias("skip_mode"), "seed", "match_rate")
    return tag(a, "constant").unionByName(tag(b, "variable"))


@query("SELECT CAST(4 AS BIGINT) AS seeds, TRUE AS plausible")
def exhaustive_statistics(spark, folder):
    """The battery over four seeds of a good generator: none of the tests is failed outright."""
    x = B.exhaustive(S.seed_space(spark, 11, 15), "xoshiro256pp", 10_000)
    ok = (F.min("chi2_p") > 1e-4) & (F.min("runs_p") > 1e-4) & (F.max(F.abs("lag1")) < 0.05) & (F.max(F.abs("lag5")) < 0.05)
    return x.agg(_n().alias("seeds"), ok.alias("plausible"))


@query("SELECT range AS seed, TRUE AS found, [13, 17, 5] AS parameters FROM range(1, 41)")
def xorshift_reconstruction(spark, folder):
    """The shifts of a 32-bit generator from five outputs of each of forty seeds."""
    s = G.with_sequence(spark.range(1, 41).withColumnRenamed("id", "seed"), "xorshift32", "seed", 5).select("seed", F.posexplode("outputs").alias("i", "v"))
    return B.per_group(s, "seed", "i", "v", B.xorshift_shifts)


@query("SELECT range AS seed, TRUE AS found, [7, 10] AS parameters FROM range(1, 11)")
def lagged_reconstruction(spark, folder):
    """The lags of an additive lagged generator from sixty values of each of ten seeds."""
    def made(seed: int) -> list[int]:
        v = [(seed * 7919 + i * i * 104729) % 1000 for i in range(10)]
        while len(v) < 60:
            v.append((v[-7] + v[-10]) % 1000)
        return v

    rows = spark.createDataFrame([(s, i, v) for s in range(1, 11) for i, v in enumerate(made(s))], "seed bigint, i int, v int")
    return B.per_group(rows, "seed", "i", "v", lambda v: B.lagged_pair(v, 1000))


@query("SELECT range AS seed, TRUE AS found, [4, 9] AS parameters FROM range(1, 11)")
def register_reconstruction(spark, folder):
    """The taps of a feedback register from eighty bits of each of ten starts."""
    def made(seed: int) -> list[int]:
        v = [(seed >> (i % 8)) & 1 for i in range(8)] + [1]
        while len(v) < 80:
            v.append(v[-4] ^ v[-9])
        return v

    rows = spark.createDataFrame([(s, i, v) for s in range(1, 11) for i, v in enumerate(made(s))], "seed bigint, i int, v int")
    return B.per_group(rows, "seed", "i", "v", B.shortest_register)


@query()
def sieve_best_trials(spark, folder):
    """Survivors of the whole seed range, with the skips and the threshold, of the best trial of each congruential family, against the last values."""
    t = table(spark, folder, "step1_trial_history").where("trial_score IS NOT NULL AND NOT isnan(trial_score)").withColumn("g", key("prng_type")).where(F.col("g").isin("java_lcg", "minstd", "lcg32"))
    best = t.groupBy("g").agg(F.max(F.struct("trial_score", (-F.col("id")).alias("i"), "seed_range_start", "seed_range_end", "skip_min", "skip_max", "forward_threshold")).alias("b")).select("g", "b.*").collect()  # a trial per family
    v, out = window_values(spark, folder, K), None
    for b in sorted(best, key=lambda r: r.g):
        s = S.fixed_skip(S.seed_space(spark, b.seed_range_start, b.seed_range_end), v, b.g, (b.skip_min, max(b.skip_min, b.skip_max)), b.forward_threshold)
        d = s.agg(_n().alias("survivors"), F.max("match_rate").alias("best_rate")).select(F.lit(b.g).alias("prng_type"), F.lit(-b.i).alias("trial_id"), F.lit(b.seed_range_end - b.seed_range_start).alias("seeds"), "survivors", "best_rate")
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "prng_type string, trial_id bigint, seeds bigint, survivors bigint, best_rate double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
