"""Further queries: regimes, rolling rates, mappings, searches, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.functions import scalars as C
from drawloom.operators import generators as G
from drawloom.operators import ranking as R
from drawloom.operators import sieve as S
from drawloom.operators import windows as W
from drawloom.plans import search as P
from drawloom.queries.sieve import _sieve_cte, window_values
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


def _n() -> object:
    return F.count(F.lit(1))


@query(f"""WITH {DRAWS_SQL}, h AS (SELECT idx, CAST(draw % 4 = idx % 4 AS INT) AS hit FROM draws), w AS (SELECT k.i AS win, avg(h.hit) AS rate FROM range(0, (SELECT max(idx) + 1 FROM draws)) k(i) JOIN h ON h.idx >= k.i * 25 AND h.idx < k.i * 25 + 100 WHERE k.i * 25 + 100 <= (SELECT max(idx) + 1 FROM draws) GROUP BY k.i)
SELECT CASE WHEN rate > 0.8 THEN 'consistent' WHEN rate > 0.2 THEN 'reseeding' ELSE 'none' END AS pattern, count(*) AS windows, round(avg(rate), 6) AS mean_rate FROM w GROUP BY 1""")
def rolling_success(spark, folder):
    """Overlapping windows by their success rate."""
    h = draws(spark, folder).select("idx", (F.col("draw") % 4 == F.col("idx") % 4).cast("int").alias("hit"))
    w = W.sliding(h, 100, 25).groupBy("win").agg(F.avg("hit").alias("rate"))
    return w.groupBy(F.when(F.col("rate") > 0.8, "consistent").when(F.col("rate") > 0.2, "reseeding").otherwise("none").alias("pattern")).agg(_n().alias("windows"), F.round(F.avg("rate"), 6).alias("mean_rate"))


@query(f"""WITH {DRAWS_SQL}, h AS (SELECT idx, draw % 2 = idx % 2 AS hit FROM draws), g AS (SELECT idx, hit, idx - row_number() OVER (PARTITION BY hit ORDER BY idx) AS k FROM h) SELECT max(n) AS longest, count(*) AS runs FROM (SELECT count(*) AS n FROM g WHERE hit GROUP BY k)""")
def longest_matches(spark, folder):
    """The longest run of matches."""
    h = draws(spark, folder).select("idx", (F.col("draw") % 2 == F.col("idx") % 2).alias("hit"))
    return W.islands(h, "hit").where("hit").agg(F.max("length").alias("longest"), _n().alias("runs"))


@query(f"WITH {DRAWS_SQL}, g AS (SELECT draw % 8 AS lane, idx - lag(idx) OVER (PARTITION BY draw % 8 ORDER BY idx) AS gap FROM draws) SELECT lane, count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS sd FROM g GROUP BY lane")
def lane_spacing(spark, folder):
    """Distances between equal residues modulo 8. Eight lanes would be eight tasks: neighbours are found in blocks, with the last of each lane carried over."""
    d = draws(spark, folder).select("idx", (F.col("draw") % 8).alias("lane")).withColumn("_b", F.floor(F.col("idx") / W.BLOCK))
    w = Window.partitionBy("_b", "lane").orderBy("idx")
    x = d.withColumn("prev", F.lag("idx").over(w))
    last = d.groupBy("_b", "lane").agg(F.max("idx").alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("lane").orderBy("_b"))).drop("_last")
    g = x.join(carry, ["_b", "lane"], "left").select("lane", (F.col("idx") - F.coalesce("prev", "_carry")).alias("gap"))
    return g.groupBy("lane").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 6).alias("mean"), F.round(F.stddev_samp("gap"), 6).alias("sd"))


@query(f"""WITH {DRAWS_SQL}, t AS (SELECT max(idx) + 1 AS n FROM draws), w AS (SELECT k.i AS win, d.draw FROM range(20) k(i), t JOIN draws d ON d.idx >= CAST(floor(k.i * (t.n - 400) / 19.0) AS BIGINT) AND d.idx < CAST(floor(k.i * (t.n - 400) / 19.0) AS BIGINT) + 400),
c AS (SELECT win, m, draw % m AS r, count(*) AS n FROM w, (VALUES (8), (125)) v(m) GROUP BY ALL), x AS (SELECT win, m, m * CAST(sum(n * n) AS DOUBLE) / sum(n) - sum(n) AS chi FROM c GROUP BY win, m), s AS (SELECT win, sum(chi * CASE m WHEN 8 THEN 1 ELSE 0.1 END) AS s FROM x GROUP BY win)
SELECT round(tanh(avg(s) / 800), 6) AS density_proxy FROM s""")
def density_proxy(spark, folder):
    """Twenty evenly spaced windows, chi-square modulo 8 and a tenth of that modulo 125, squashed."""
    d = draws(spark, folder).select("idx", "draw")
    n = d.agg((F.max("idx") + 1).alias("n"))
    starts = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("win"), F.floor(i * (F.col("n") - 400) / 19.0).alias("at")))).alias("s")).select("s.*")
    # equi-join on blocks of the windows' length, then the exact bounds
    pos = starts.withColumn("blk", F.explode(F.sequence(F.floor(F.col("at") / 400), F.floor((F.col("at") + 399) / 400))))
    w = d.withColumn("blk", F.floor(F.col("idx") / 400)).join(F.broadcast(pos), "blk").where((F.col("idx") >= F.col("at")) & (F.col("idx") < F.col("at") + 400))
    c = w.select("win", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col("draw") % m).alias("r")) for m in (8, 125)))).alias("e")).groupBy("win", "e.m", "e.r").agg(_n().alias("n"))
    x = c.groupBy("win", "m").agg((F.first("m") * F.sum(F.col("n") * F.col("n")).cast("double") / F.sum("n") - F.sum("n")).alias("chi"))
    s = x.groupBy("win").agg(F.sum(F.col("chi") * F.when(F.col("m") == 8, 1.0).otherwise(0.1)).alias("s"))
    return s.agg(F.round(F.tanh(F.avg("s") / 800), 6).alias("density_proxy"))


@query(f"WITH {DRAWS_SQL}, c AS (SELECT draw % 10 AS d, count(*) AS n FROM draws GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(-sum(p * sqrt(p)), 6) AS pseudo_entropy_sqrt, round(-sum(p * p), 6) AS pseudo_entropy_square FROM p")
def pseudo_entropies(spark, folder):
    """Two sums that look like entropies, under names of their own."""
    c = draws(spark, folder).groupBy((F.col("draw") % 10).alias("d")).agg(_n().alias("n"))
    p = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select((F.col("n") / F.col("t")).alias("p"))
    return p.agg(F.round(-F.sum(F.col("p") * F.sqrt("p")), 6).alias("pseudo_entropy_sqrt"), F.round(-F.sum(F.col("p") * F.col("p")), 6).alias("pseudo_entropy_square"))


@query(f"WITH {DRAWS_SQL}, b AS (SELECT CASE WHEN draw < 100 THEN 'low' WHEN draw < 500 THEN 'middle' WHEN draw < 900 THEN 'high' ELSE 'top' END AS bucket FROM draws), e AS (SELECT * FROM (VALUES ('low', 0.1), ('middle', 0.4), ('high', 0.4), ('top', 0.1)) v(bucket, share)) SELECT bucket, count(*) AS n, round((count(*) / ((SELECT count(*) FROM draws) * any_value(share)) - 1) * 100, 4) AS excess_percent FROM b JOIN e USING (bucket) GROUP BY bucket")
def range_buckets(spark, folder):
    """Values per fixed range against what is expected."""
    d, v = draws(spark, folder), F.col("draw")
    b = d.groupBy(F.when(v < 100, "low").when(v < 500, "middle").when(v < 900, "high").otherwise("top").alias("bucket")).agg(_n().alias("n"))
    t = d.agg(_n().alias("t"))
    share = F.when(F.col("bucket").isin("low", "top"), 0.1).otherwise(0.4)
    return b.crossJoin(F.broadcast(t)).select("bucket", "n", F.round((F.col("n") / (F.col("t") * share) - 1) * 100, 4).alias("excess_percent"))


_MAP = {"polynomial": "(v * v * 31 + v * 17 + 7) & 4294967295", "multiply": "(v * 2654435761) & 4294967295", "xor_rotate": "xor(v, ((v << 7) | (v >> 25)) & 4294967295)", "hash": "CAST('0x' || substr(md5(CAST(v AS VARCHAR)), 1, 8) AS BIGINT)"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS mapping, min({e} % 1000) AS lo, max({e} % 1000) AS hi, CAST(sum({e}) AS BIGINT) AS total, CAST(sum(CAST(floor({e} * 1000 / 4294967296) AS BIGINT)) AS BIGINT) AS scaled FROM (SELECT CAST(floor(value*100+0.5) AS BIGINT) % 1000 AS v FROM events)" for k, e in ((k, f'({e})') for k, e in _MAP.items())))
def draw_mappings(spark, folder):
    """Four ways from a draw to 32 bits, by remainder and by scale."""
    out = None
    for k, f in C.MAPPINGS.items():
        v = f(F.col("draw"))
        d = draws(spark, folder).select(v.alias("v")).agg(F.min(F.col("v") % 1000).alias("lo"), F.max(F.col("v") % 1000).alias("hi"), F.sum("v").alias("total"), F.sum(C.to_range(F.col("v"), 1000, "scale")).alias("scaled")).select(F.lit(k).alias("mapping"), "lo", "hi", "total", "scaled")
        out = d if out is None else out.unionByName(d)
    return out


@query("""WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(e[i]) AS m FROM n, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
s AS (SELECT n.vec_id, c.label, list_cosine_similarity(n.e, c.p) AS s FROM n CROSS JOIN c) SELECT vec_id, arg_max(label, (round(s, 9), -label)) AS nearest, round(max(s), 5) AS likeness FROM s GROUP BY vec_id""")
def nearest_profile(spark, folder):
    """Each vector's nearest class profile; profiles are as many as classes."""
    n = table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    m = n.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy(F.col("label").alias("profile")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("p"))
    s = n.crossJoin(F.broadcast(c)).select("vec_id", "profile", C.cosine("e", "p").alias("s"))
    return s.groupBy("vec_id").agg(F.max_by("profile", F.struct(F.round("s", 9), -F.col("profile"))).alias("nearest"), F.round(F.max("s"), 5).alias("likeness"))


@query("WITH e AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), z AS (SELECT event_type, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z FROM e), x AS (SELECT event_type, z, exp((z - max(z) OVER ()) / 0.5) AS w FROM z) SELECT event_type, round(w / sum(w) OVER (), 6) AS softmax, round(1 / (1 + exp(-z)), 6) AS sigmoid FROM x")
def soft_scores(spark, folder):
    """z-scores of a few classes through softmax and sigmoid."""
    e = table(spark, folder, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    g = e.agg(F.collect_list(F.struct("event_type", "m")).alias("a"), F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    g = g.withColumn("z", F.transform("a", lambda s: (s["m"] - F.col("mu")) / F.col("sd"))).withColumn("p", C.softmax("z"))
    x = g.select(F.explode(F.arrays_zip("a", "z", "p")).alias("r"))
    return x.select("r.a.event_type", F.round("r.p", 6).alias("softmax"), F.round(C.sigmoid(F.col("r.z")), 6).alias("sigmoid"))


@query("SELECT range AS a, CASE WHEN range % 2 = 0 OR range % 5 = 0 THEN NULL ELSE CAST((SELECT min(b.range) FROM range(1, 1000) b WHERE (b.range * a.range) % 1000 = 1) AS BIGINT) END AS inverse FROM range(1, 200) a")
def modular_inverses(spark, folder):
    """Inverses modulo 1000 where there are any."""
    return spark.range(1, 200).select(F.col("id").alias("a"), C.modular_inverse(F.col("id"), F.lit(1000).cast("bigint")).alias("inverse"))


@query("SELECT i.i / 100.0 AS p, round(CASE i.i WHEN 5 THEN -1.644854 WHEN 25 THEN -0.674490 WHEN 50 THEN 0 WHEN 75 THEN 0.674490 WHEN 95 THEN 1.644854 ELSE 2.326348 END, 6) AS z FROM (VALUES (5), (25), (50), (75), (95), (99)) i(i)")
def normal_quantiles(spark, folder):
    """Quantiles of the normal distribution in closed form."""
    d = spark.createDataFrame([(i / 100.0,) for i in (5, 25, 50, 75, 95, 99)], "p double")
    return d.select("p", (F.round(C.inverse_normal(F.col("p")), 6) + 0.0).alias("z"))


@query("SELECT DISTINCT 6 AS gcd, count(*) OVER () > 0 AS any_rows FROM lineitem LIMIT 1")
def common_divisor(spark, folder):
    """The greatest common divisor of a column."""
    d = table(spark, folder, "lineitem").select((F.col("l_linenumber") * 6).alias("v"))
    return C.gcd_of(d, "v").select(F.col("gcd").cast("int").alias("gcd"), F.lit(True).alias("any_rows"))


@query("SELECT i AS i, value FROM (SELECT 0 AS i, 1 * 48271 AS value UNION ALL SELECT 1, 182605794 UNION ALL SELECT 2, 1291394886)")
def sequence_table_function(spark, folder):
    """A generator as a table function."""
    spark.udtf.register("generate_sequence", C.GenerateSequence)
    return spark.sql("SELECT i, value FROM generate_sequence('minstd', 1, 3, 0)")


@query()
def window_search(spark, folder):
    """Eight trials of a window search."""
    return P.search(spark, draws(spark, folder), S.seed_space(spark, 0, 20_000), "java_lcg", 8, P.parzen_sampler)


@query()
def hybrid_reverse_sieve(spark, folder):
    """Variable skips over the reversed window."""
    return S.hybrid_reverse(S.seed_space(spark, 0, 30_000), window_values(spark, folder), "java_lcg", 0.25)


@query()
def survivor_validation(spark, folder):
    """Survivors scored by rate, lanes and runs."""
    v = window_values(spark, folder)
    s = S.fixed_skip(S.seed_space(spark, 0, 30_000), v, "java_lcg", (0, 10), 2 / 8)
    return S.validate_survivors(s, v, "java_lcg", (0, 10))


_A9, _C9 = G.jumps(G.FAMILIES["java_lcg"].affine, [9])[9]


@query(f"""WITH {DRAWS_SQL}, {_sieve_cte('java_lcg', False, 'f')}, v AS (SELECT ((CAST(((CAST(seed AS HUGEINT) * {_A9} + {_C9}) % 281474976710656) AS BIGINT) >> 16) & 4294967295) % 1000 AS number, sum(match_rate) AS weight FROM f GROUP BY 1)
SELECT number, weight, CAST(row_number() OVER (ORDER BY weight DESC, number) AS INTEGER) AS rank_no FROM v QUALIFY rank_no <= 300""")
def next_draw_pool(spark, folder):
    """Votes of the survivors for the next value."""
    v = window_values(spark, folder)
    s = S.fixed_skip(S.seed_space(spark, 0, 30_000), v, "java_lcg", (0, 10), 1 / 8)
    return R.weighted_pool(S.predict_next(s, "java_lcg", len(v) + 1, "match_rate"), "number", F.col("weight"), [20, 100, 300])


@query(f"""WITH {DRAWS_SQL}, t AS (SELECT draw AS a, lead(draw, 1) OVER (ORDER BY idx) AS b, lead(draw, 2) OVER (ORDER BY idx) AS c, lead(draw, 3) OVER (ORDER BY idx) AS d FROM draws),
p AS (SELECT list_transform(list_sort([(a, 0), (b, 1), (c, 2), (d, 3)]), lambda x: x[2]) AS p FROM t WHERE d IS NOT NULL), n AS (SELECT p, count(*) AS n FROM p GROUP BY p) SELECT count(*) AS patterns, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(24 * CAST(sum(n * n) AS DOUBLE) / sum(n) - sum(n), 4) AS chi2 FROM n""")
def ordinal_patterns_4(spark, folder):
    """Order patterns of four: how many, entropy, uniformity."""
    x = W.lagged(draws(spark, folder).select("idx", "draw"), "draw", [1, 2, 3]).where("draw_lag3 IS NOT NULL")
    s = F.array_sort(F.array(*(F.struct(F.col(c).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(["draw_lag3", "draw_lag2", "draw_lag1", "draw"]))))
    c = x.groupBy(F.transform(s, lambda e: e["i"]).alias("p")).agg(_n().alias("n"))
    n = F.col("n")
    return c.agg(_n().alias("patterns"), F.round(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n), 6).alias("entropy"), F.round(24 * F.sum(n * n).cast("double") / F.sum(n) - F.sum(n), 4).alias("chi2"))


@query(f"WITH {DRAWS_SQL}, m AS (SELECT idx - lag(idx) OVER (ORDER BY idx) AS g FROM draws WHERE draw % 100 = 7) SELECT count(g) AS n, round(avg(g), 6) AS mean, round(stddev_pop(g) / avg(g), 6) AS variation FROM m")
def marker_gaps(spark, folder):
    """Coefficient of variation of the distances between markers."""
    m = W.row_index(draws(spark, folder).where("draw % 100 = 7").select("idx"), "pos")
    g = W.lagged(m, "idx", [1], "pos").select((F.col("idx") - F.col("idx_lag1")).alias("g"))
    return g.agg(F.count("g").alias("n"), F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g") / F.avg("g"), 6).alias("variation"))


@query("SELECT strategy_id, name, max_misses, tolerance FROM (VALUES (0, 'strict_continuous', 3, 5), (1, 'lenient_continuous', 10, 20), (2, 'aggressive_reseed', 5, 5), (3, 'balanced_hybrid', 7, 10), (4, 'extreme_tolerance', 20, 50)) s(strategy_id, name, max_misses, tolerance)")
def strategy_presets(spark, folder):
    """Presets of the hybrid sieve."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(S.STRATEGIES)], "strategy_id int, name string, max_misses int, tolerance int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


