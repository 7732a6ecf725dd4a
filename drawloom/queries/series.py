"""Queries over the ordered series of draws, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.functions import stats
from drawloom.operators import windows as W
from drawloom.sources.tables import DRAWS_SQL, draws, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function as a query under its name, with its oracle."""

    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _with(body: str) -> str:
    return f"WITH {DRAWS_SQL}{body}"


def _r(c, d: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, d)


@query(_with(""", f AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM draws WHERE session = 'evening')
SELECT idx, draw, session, date, CAST(p - greatest(0, least(100, n - 400)) AS INTEGER) AS pos FROM f
WHERE p >= greatest(0, least(100, n - 400)) AND p < greatest(0, least(100, n - 400)) + 400"""))  # fmt: skip
def draw_window_scan(spark, folder):
    """400 evening draws from offset 100."""
    return W.window_scan(draws(spark, folder), 400, 100, ["evening"])


@query(_with(""" SELECT session, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, CAST(sum(draw) AS BIGINT) AS total FROM draws WHERE session IN ('midday', 'evening') GROUP BY session"""))
def session_split(spark, folder):
    """The two sessions apart; any other session belongs to neither."""
    d = draws(spark, folder).where(F.col("session").isin("midday", "evening"))
    return d.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("draw").alias("total"))


def _residues(d: DataFrame, mods=(8, 125, 1000)) -> DataFrame:
    return d.select("idx", "draw", F.explode(F.array(*map(F.lit, mods))).alias("m")).withColumn("residue", F.col("draw") % F.col("m"))


_RES_SQL = ", res AS (SELECT idx, m, draw % m AS residue FROM draws, (VALUES (8), (125), (1000)) v(m)), rc AS (SELECT m, residue, count(*) AS n FROM res GROUP BY ALL)"


@query(_with(f"{_RES_SQL} SELECT CAST(m AS INTEGER) AS m, residue, n FROM rc"))
def residue_histogram(spark, folder):
    """Counts of draw modulo 8, 125 and 1000."""
    return _residues(draws(spark, folder)).groupBy("m", "residue").agg(F.count(F.lit(1)).alias("n"))


@query(_with(f"{_RES_SQL} SELECT CAST(m AS INTEGER) AS m, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM rc GROUP BY m"))
def residue_entropy(spark, folder):
    """Entropy in bits of the residues."""
    return stats.entropy_bits(by=["m"], df=residue_histogram(spark, folder)).withColumn("entropy", _r(F.col("entropy")))


@query(_with(f"""{_RES_SQL}, g AS (SELECT m, residue, n FROM rc UNION ALL SELECT v.m, r.i, 0 FROM (VALUES (8), (125), (1000)) v(m), range(1000) r(i) WHERE r.i < v.m AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.m = v.m AND rc.residue = r.i)),
t AS (SELECT m, (n / sum(n) OVER (PARTITION BY m) + 1e-10) / (1 + m * 1e-10) AS p FROM g)
SELECT CAST(m AS INTEGER) AS m, round(-sum(p * ln(p)) / ln(m), 6) AS entropy FROM t GROUP BY m"""))  # fmt: skip
def residue_entropy_normalised(spark, folder):
    """Smoothed entropy as a share of the greatest possible one."""
    h = residue_histogram(spark, folder)
    out = None
    for m in (8, 125, 1000):
        e = stats.entropy_smoothed(h.where(F.col("m") == m), m).select(F.lit(m).alias("m"), _r(F.col("entropy")).alias("entropy"))
        out = e if out is None else out.unionByName(e)
    return out


_Z = "(pow(chi2 / (m - 1), 1.0 / 3) - (1 - 2 / (9.0 * (m - 1)))) / sqrt(2 / (9.0 * (m - 1)))"


@query(_with(f"""{_RES_SQL}, c AS (SELECT m, CAST(sum(n) AS BIGINT) AS total, m * CAST(sum(n * n) AS DOUBLE) / sum(n) - sum(n) AS chi2 FROM rc GROUP BY m)
SELECT CAST(m AS INTEGER) AS m, total, round(chi2, 4) AS chi2, round(1 - {stats.normal_cdf_sql(_Z)}, 5) AS p_value FROM c"""))  # fmt: skip
def residue_chi_square(spark, folder):
    """Uniformity of the residues."""
    h = residue_histogram(spark, folder)
    out = None
    for m in (8, 125, 1000):
        e = stats.chi_square(h.where(F.col("m") == m), m).select(F.lit(m).alias("m"), "total", _r(F.col("chi2"), 4).alias("chi2"), _r(F.col("p_value"), 5).alias("p_value"))
        out = e if out is None else out.unionByName(e)
    return out


_DIG = ", dg AS (SELECT idx, place, CAST(CASE place WHEN 0 THEN draw // 100 WHEN 1 THEN (draw // 10) % 10 ELSE draw % 10 END AS INTEGER) AS digit FROM draws, (VALUES (0), (1), (2)) v(place))"


def _digits(d: DataFrame) -> DataFrame:
    a = F.array(F.floor(F.col("draw") / 100) % 10, F.floor(F.col("draw") / 10) % 10, F.col("draw") % 10)
    return d.select("idx", F.posexplode(F.transform(a, lambda x: x.cast("int"))).alias("place", "digit"))


@query(_with(f"{_DIG}, c AS (SELECT place, digit, count(*) AS n FROM dg GROUP BY ALL) SELECT place, round(10 * CAST(sum(n * n) AS DOUBLE) / sum(n) - sum(n), 4) AS chi2, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY place"))
def digit_chi_square(spark, folder):
    """Uniformity of each decimal digit."""
    c = _digits(draws(spark, folder)).groupBy("place", "digit").agg(F.count(F.lit(1)).alias("n"))
    most = c.groupBy("place").agg(F.max("n").alias("most"))
    return stats.chi_square(c, 10, ["place"]).join(F.broadcast(most), "place").select("place", _r(F.col("chi2"), 4).alias("chi2"), "most")


@query(_with(""", g AS (SELECT draw, idx - lag(idx) OVER (PARTITION BY draw ORDER BY idx) AS gap FROM draws)
SELECT draw, count(gap) AS n, round(avg(gap), 6) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap, round(CASE WHEN count(gap) > 1 THEN var_samp(gap) END, 4) AS var_gap FROM g GROUP BY draw HAVING count(gap) > 0"""))
def gap_stats(spark, folder):
    """Distances between equal draws."""
    g = W.gaps(draws(spark, folder), "draw").where("gap IS NOT NULL")
    return g.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("gap")).alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), _r(F.when(F.count(F.lit(1)) > 1, F.var_samp("gap")), 4).alias("var_gap"))


@query(_with(""", s AS (SELECT idx, draw % 8 AS lane, CASE WHEN draw % 8 = lag(draw % 8) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM draws),
i AS (SELECT *, sum(ch) OVER (ORDER BY idx) AS isl FROM s), g AS (SELECT isl, any_value(lane) AS lane, min(idx) AS f, max(idx) AS l, count(*) AS n FROM i GROUP BY isl)
SELECT lane, f AS first, l AS last, n AS length FROM g WHERE n >= 3 AND l < (SELECT max(idx) FROM draws)"""))
def streaks(spark, folder):
    """Runs of three or more equal residues mod 8."""
    d = draws(spark, folder).select("idx", (F.col("draw") % 8).alias("lane"))
    return W.streaks(d, "lane", 3).select("lane", "first", "last", "length")


@query(_with(""", s AS (SELECT idx, (draw % 2) AS lane, CASE WHEN draw % 2 = lag(draw % 2) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM draws),
i AS (SELECT lane, idx, sum(ch) OVER (ORDER BY idx) AS isl FROM s), g AS (SELECT isl, any_value(lane) AS lane, max(idx) AS l, count(*) AS n FROM i GROUP BY isl)
SELECT (SELECT n FROM g ORDER BY l DESC LIMIT 1) AS regime_age, count(*) - 1 AS switches, round((count(*) - 1) / (SELECT count(*) - 1 FROM draws), 6) AS switch_rate, max(n) AS longest FROM g"""))
def trailing_run(spark, folder):
    """Length of the run at the end, number and rate of changes, longest run."""
    i = W.islands(draws(spark, folder).select("idx", (F.col("draw") % 2).alias("lane")), "lane")
    n = F.sum("length")
    return i.agg(F.max_by("length", "last").alias("regime_age"), (F.count(F.lit(1)) - 1).alias("switches"), _r((F.count(F.lit(1)) - 1) / (n - 1)).alias("switch_rate"), F.max("length").alias("longest"))


@query(_with(""" SELECT l.lag AS lag, count(*) AS n, CAST(sum(CAST(a.draw // 100 = b.draw // 100 AS INT) + CAST((a.draw // 10) % 10 = (b.draw // 10) % 10 AS INT) + CAST(a.draw % 10 = b.draw % 10 AS INT)) AS BIGINT) AS agreements
 FROM range(1, 21) l(lag) JOIN draws a ON TRUE JOIN draws b ON b.idx = a.idx + l.lag GROUP BY l.lag"""))
def digit_autocorrelation(spark, folder):
    """Digits that agree with those 1 to 20 draws before: lags by one windowed pass, not twenty joins."""
    lags = range(1, 21)
    x = W.lagged(draws(spark, folder).select("idx", "draw"), "draw", list(lags))
    dig = lambda c: [F.floor(c / 100), F.floor(c / 10) % 10, c % 10]
    same = lambda n: sum((a == b).cast("int") for a, b in zip(dig(F.col("draw")), dig(F.col(f"draw_lag{n}"))))
    # twenty sums in one row, not twenty rows for each draw
    row = x.agg(*(F.count(f"draw_lag{n}").alias(f"n{n}") for n in lags), *(F.sum(same(n)).alias(f"a{n}") for n in lags))
    each = F.explode(F.array(*(F.struct(F.lit(n).cast("bigint").alias("lag"), F.col(f"n{n}").alias("n"), F.col(f"a{n}").alias("agreements")) for n in lags)))
    return row.select(each.alias("e")).select("e.*").where("n > 0")


@query(_with(""", t AS (SELECT lag(draw % 10) OVER (ORDER BY idx) AS prev, draw % 10 AS next FROM draws), c AS (SELECT prev, next, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL)
SELECT prev, next, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS p FROM c"""))
def digit_transitions(spark, folder):
    """Transition matrix of the last digit."""
    return W.transitions(draws(spark, folder), F.col("draw") % 10).withColumn("p", _r(F.col("p")))


@query(_with(""", t AS (SELECT lag(draw % 8) OVER (ORDER BY idx) AS prev, draw % 8 AS next FROM draws), c AS (SELECT a.i AS prev, b.i AS next, count(t.next) AS n FROM range(8) a(i) CROSS JOIN range(8) b(i) LEFT JOIN t ON t.prev = a.i AND t.next = b.i GROUP BY ALL)
SELECT prev, next, n, round((n + 1) / (sum(n) OVER (PARTITION BY prev) + 8), 6) AS p FROM c"""))
def lane_transitions_smoothed(spark, folder):
    """Transition matrix mod 8 with one added to each cell."""
    return W.transitions(draws(spark, folder), F.col("draw") % 8, smooth=1.0, states=8).withColumn("p", _r(F.col("p")))


@query(_with(""", w AS (SELECT k.i AS win, d.draw % 8 AS r FROM range(0, (SELECT max(idx) + 1 FROM draws)) k(i) JOIN draws d ON d.idx >= k.i * 50 AND d.idx < k.i * 50 + 200 WHERE k.i * 50 + 200 <= (SELECT max(idx) + 1 FROM draws)),
c AS (SELECT win, r, count(*) AS n FROM w GROUP BY ALL) SELECT win, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY win"""))
def sliding_entropy(spark, folder):
    """Entropy mod 8 of windows of 200 draws, 50 apart."""
    x = W.sliding(draws(spark, folder).select("idx", (F.col("draw") % 8).alias("r")), 200, 50)
    c = x.groupBy("win", "r").agg(F.count(F.lit(1)).alias("n"))
    return stats.entropy_bits(by=["win"], df=c).withColumn("entropy", _r(F.col("entropy")))


@query(_with(f""", w AS (SELECT k.i AS win, d.draw FROM range(0, (SELECT max(idx) + 1 FROM draws)) k(i) JOIN draws d ON d.idx >= k.i * 100 AND d.idx < k.i * 100 + 400 WHERE k.i * 100 + 400 <= (SELECT max(idx) + 1 FROM draws)),
c AS (SELECT win, m, draw % m AS r, count(*) AS n FROM w, (VALUES (8), (125), (1000)) v(m) GROUP BY ALL), e AS (SELECT win, m, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL),
d AS (SELECT win, m, abs(h - lag(h) OVER (PARTITION BY m ORDER BY win)) AS dh FROM e), s AS (SELECT win, sum(dh * CASE m WHEN 8 THEN .2 WHEN 125 THEN .3 ELSE .5 END) AS drift, sum(CAST(dh > 0.05 AS INT)) AS lanes_triggered FROM d WHERE dh IS NOT NULL GROUP BY win),
z AS (SELECT win, drift, lanes_triggered, (drift - avg(drift) OVER ()) / nullif(stddev_pop(drift) OVER (), 0) AS z FROM s)
SELECT win, round(drift, 6) AS drift, CAST(lanes_triggered AS BIGINT) AS lanes_triggered, round(z, 4) AS z FROM z WHERE z > 1.5"""))  # fmt: skip
def drift_boundaries(spark, folder):
    """Windows whose entropies jump: weighted change per lane, as a z-score over all windows; above 1.5."""
    x = W.sliding(draws(spark, folder).select("idx", "draw"), 400, 100)
    c = _residues(x.select(F.col("win").alias("idx"), "draw")).groupBy(F.col("idx").alias("win"), "m", "residue").agg(F.count(F.lit(1)).alias("n"))
    e = stats.entropy_bits(by=["win", "m"], df=c)
    wide = e.groupBy("win").pivot("m", [8, 125, 1000]).agg(F.first("entropy")).toDF("win", "h8", "h125", "h1000")
    d = W.lagged(wide, ["h8", "h125", "h1000"], [1], "win").where("h8_lag1 IS NOT NULL")
    diffs = {h: F.abs(F.col(h) - F.col(f"{h}_lag1")) for h in ("h8", "h125", "h1000")}
    d = d.select("win", sum(w * diffs[h] for h, w in (("h8", 0.2), ("h125", 0.3), ("h1000", 0.5))).alias("drift"), sum((x > 0.05).cast("bigint") for x in diffs.values()).alias("lanes_triggered"))
    g = d.agg(F.avg("drift").alias("_m"), F.stddev_pop("drift").alias("_s"))
    return d.crossJoin(F.broadcast(g)).withColumn("z", (F.col("drift") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).where("z > 1.5").select("win", _r(F.col("drift")).alias("drift"), "lanes_triggered", _r(F.col("z"), 4).alias("z"))


@query(_with(""", c AS (SELECT draw, count(*) AS n, max(idx) AS l FROM draws GROUP BY draw), t AS (SELECT count(*) AS n, max(idx) AS last FROM draws)
SELECT round((SELECT CAST(max(n) AS DOUBLE) / min(n) FROM c), 6) AS frequency_ratio,
 round((SELECT sum(CASE WHEN draw IN (1,2,4,8,16,32,64,128,256,512) THEN n ELSE 0 END) FROM c) / t.n / 0.01, 6) AS power_of_two_bias,
 round((SELECT avg(CASE WHEN c.l IS NULL OR t.last - c.l > 500 THEN 1.0 ELSE 0 END) FROM range(1000) r(i) LEFT JOIN c ON c.draw = r.i), 6) AS suspicious_gap_share FROM t"""))
def global_bias(spark, folder):
    """Most to least frequent value, powers of two against their share, share of values long unseen."""
    d = draws(spark, folder)
    c = d.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("l"))
    p2 = F.col("draw").isin(*(1 << i for i in range(10)))
    t = c.agg(F.sum("n").alias("t"), F.max("l").alias("last"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum(F.when(p2, F.col("n")).otherwise(0)).alias("p2"))
    full = spark.range(1000).select(F.col("id").alias("draw")).join(c, "draw", "left").crossJoin(F.broadcast(t))
    return full.agg(
        _r(F.first("hi") / F.first("lo")).alias("frequency_ratio"),
        _r(F.first("p2") / F.first("t") / 0.01).alias("power_of_two_bias"),
        _r(F.avg(F.when(F.col("l").isNull() | (F.col("last") - F.col("l") > 500), 1.0).otherwise(0.0))).alias("suspicious_gap_share"),
    )


@query(_with(""", t AS (SELECT max(idx) AS last FROM draws), a AS (SELECT draw, sum(CASE WHEN idx > last - 1000 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN idx <= last - 1000 THEN 1 ELSE 0 END) AS o FROM draws, t WHERE idx > last - 2000 GROUP BY draw),
g AS (SELECT (coalesce(n, 0) + 1) / 2000.0 AS p, (coalesce(o, 0) + 1) / 2000.0 AS q FROM range(1000) r(i) LEFT JOIN a ON a.draw = r.i) SELECT round(sum(p * ln(p / q)), 6) AS kl FROM g"""))
def regime_kl(spark, folder):
    """Divergence of the last 1000 draws from the 1000 before, one added to each value."""
    d = draws(spark, folder)
    last = d.agg(F.max("idx").alias("last"))
    near = d.crossJoin(F.broadcast(last)).where(F.col("idx") > F.col("last") - 2000)
    new = F.col("idx") > F.col("last") - 1000
    c = near.groupBy("draw").agg(F.sum(new.cast("int")).alias("n"), F.sum((~new).cast("int")).alias("o"))
    g = spark.range(1000).select(F.col("id").alias("draw")).join(c, "draw", "left")
    p, q = ((F.coalesce(F.col(x), F.lit(0)) + 1) / 2000.0 for x in ("n", "o"))
    return g.agg(_r(F.sum(stats.kl(p, q))).alias("kl"))


@query(_with(""" SELECT CASE WHEN grouping(y) = 0 THEN 'year' ELSE 'month' END AS level, coalesce(y, m) AS period, count(*) AS n, round(avg(draw), 6) AS mean, round(median(draw), 2) AS median, round(stddev_samp(draw), 6) AS sd
 FROM (SELECT strftime(date, '%Y') AS y, strftime(date, '%Y-%m') AS m, draw FROM draws) GROUP BY GROUPING SETS ((y), (m))"""))
def rollup_year_month(spark, folder):
    """Grouping sets over year and month."""
    d = draws(spark, folder).select(F.date_format("date", "yyyy").alias("y"), F.date_format("date", "yyyy-MM").alias("m"), "draw")
    g = d.groupingSets([[F.col("y")], [F.col("m")]], F.col("y"), F.col("m")).agg(F.count(F.lit(1)).alias("n"), F.avg("draw").alias("mean"), F.median("draw").alias("median"), F.stddev_samp("draw").alias("sd"))
    return g.select(F.when(F.col("y").isNotNull(), "year").otherwise("month").alias("level"), F.coalesce("y", "m").alias("period"), "n", _r(F.col("mean")).alias("mean"), _r(F.col("median"), 2).alias("median"), _r(F.col("sd")).alias("sd"))


@query(_with(""", b AS (SELECT bit_count(idx * 2654435761 % 4294967296) AS b FROM draws) SELECT round(avg(b), 6) AS mean_bits, round(stddev_samp(b), 6) AS sd_bits, round(avg(b) - 16, 6) AS bias FROM b"""))
def popcount_battery(spark, folder):
    """Bit counts of a 32-bit multiplicative hash of the position."""
    b = draws(spark, folder).select(F.bit_count(F.col("idx") * 2654435761 % 4294967296).alias("b"))
    return b.agg(_r(F.avg("b")).alias("mean_bits"), _r(F.stddev_samp("b")).alias("sd_bits"), _r(F.avg("b") - 16).alias("bias"))


@query(_with(""", m AS (SELECT avg(draw) AS m FROM draws), c AS (SELECT idx, sum(draw) OVER (ORDER BY idx) - m * (idx + 1) AS c FROM draws, m), z AS (SELECT idx, sign(c) AS s, lag(sign(c)) OVER (ORDER BY idx) AS p FROM c WHERE abs(c) > 1e-6)
SELECT round((SELECT max(abs(c)) FROM c), 3) AS max_excursion, round((SELECT avg(abs(c)) FROM c), 3) AS mean_excursion, (SELECT count(*) FROM z WHERE p IS NOT NULL AND s <> p) AS zero_crossings"""))
def cusum(spark, folder):
    """Excursions of the cumulated, centred series, and how often it crosses zero (zeros are passed over)."""
    d = draws(spark, folder).select("idx", "draw")
    m = d.agg(F.avg("draw").alias("m"))
    c = W.running_sum(d, F.col("draw"), "s").crossJoin(F.broadcast(m)).select("idx", (F.col("s") - F.col("m") * (F.col("idx") + 1)).alias("c"))
    nz = W.row_index(c.where(F.abs(F.col("c")) > 1e-6).withColumn("sg", F.signum("c")), "pos")
    z = W.lagged(nz.select("pos", "sg"), "sg", [1], "pos").where("sg_lag1 <> sg").agg(F.count(F.lit(1)).alias("zero_crossings"))
    return c.agg(_r(F.max(F.abs("c")), 3).alias("max_excursion"), _r(F.avg(F.abs("c")), 3).alias("mean_excursion")).crossJoin(F.broadcast(z))


#: 1 to 10, the even ones to 30, and those of weeks, months, quarters and half years.
_LAGS = sorted({*range(1, 11), *range(12, 31, 2), 7, 14, 21, 28, 30, 60, 90, 180})


@query(_with(f""", m AS (SELECT avg(draw) AS m, var_pop(draw) AS v, count(*) AS n FROM draws), x AS (SELECT idx, draw - m AS x FROM draws, m)
SELECT l.lag AS lag, round(sum(a.x * b.x) / ((any_value(m.n) - l.lag) * any_value(m.v)), 6) AS r, abs(sum(a.x * b.x) / ((any_value(m.n) - l.lag) * any_value(m.v))) > 2 / sqrt(any_value(m.n) - l.lag) AS significant
 FROM (VALUES {', '.join(f'({x})' for x in _LAGS)}) l(lag) JOIN x a ON TRUE JOIN x b ON b.idx = a.idx + l.lag CROSS JOIN m GROUP BY l.lag"""))
def autocorrelation(spark, folder):
    """Autocorrelation over a set of lags, with the two-sigma test."""
    d = draws(spark, folder).select("idx", "draw")
    m = d.agg(F.avg("draw").alias("m"), F.var_pop("draw").alias("v"), F.count(F.lit(1)).alias("n"))
    x = W.lagged(d, "draw", _LAGS).crossJoin(F.broadcast(m))
    c = lambda n: (F.col("draw") - F.col("m")) * (F.col(f"draw_lag{n}") - F.col("m"))
    row = x.agg(F.first("v").alias("v"), F.first("n").alias("n"), *(F.sum(c(n)).alias(f"s{n}") for n in _LAGS))
    g = row.select("v", "n", F.explode(F.array(*(F.struct(F.lit(n).alias("lag"), F.col(f"s{n}").alias("s")) for n in _LAGS))).alias("e")).select("v", "n", "e.*").where("s IS NOT NULL")
    r = F.col("s") / ((F.col("n") - F.col("lag")) * F.col("v"))
    return g.select("lag", _r(r).alias("r"), (F.abs(r) > 2 / F.sqrt(F.col("n") - F.col("lag"))).alias("significant"))


@query(_with(""", t AS (SELECT draw AS a, lead(draw, 1) OVER (ORDER BY idx) AS b, lead(draw, 2) OVER (ORDER BY idx) AS c FROM draws),
p AS (SELECT CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN c < a AND a <= b THEN '201' WHEN b <= c AND c < a THEN '120' ELSE '210' END AS pattern FROM t WHERE c IS NOT NULL)
SELECT pattern, count(*) AS n FROM p GROUP BY pattern"""))
def ordinal_patterns(spark, folder):
    """Order patterns of three draws in a row (a stable argsort), counted."""
    x = W.lagged(draws(spark, folder).select("idx", "draw"), "draw", [1, 2]).where("draw_lag2 IS NOT NULL")
    s = F.array_sort(F.array(*(F.struct(F.col(c).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(["draw_lag2", "draw_lag1", "draw"]))))
    return x.select(F.concat_ws("", F.transform(s, lambda e: e["i"].cast("string"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


_ZR = "((runs - mu) / sqrt(vr))"


@query(_with(f""", md AS (SELECT median(draw) AS md FROM draws), s AS (SELECT idx, draw > md AS up FROM draws, md), g AS (SELECT up, CASE WHEN up = lag(up) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM s),
c AS (SELECT CAST(sum(ch) AS BIGINT) AS runs, CAST(count(*) FILTER (up) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT up) AS DOUBLE) AS b FROM g),
z AS (SELECT runs, 2 * a * b / (a + b) + 1 AS mu, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) AS vr FROM c)
SELECT runs, round({_ZR}, 5) AS z, round(2 * (1 - {stats.normal_cdf_sql(f'abs({_ZR})')}), 5) AS p_value FROM z"""))  # fmt: skip
def runs_test(spark, folder):
    """Runs above and below the median, z and two-sided p."""
    d = draws(spark, folder).select("idx", "draw")
    s = d.crossJoin(F.broadcast(d.agg(F.median("draw").alias("md")))).select("idx", (F.col("draw") > F.col("md")).cast("int").alias("up"))
    x = W.lagged(s, "up", [1])
    c = x.agg(F.sum((F.col("up_lag1").isNull() | (F.col("up") != F.col("up_lag1"))).cast("bigint")).alias("runs"), F.sum("up").cast("double").alias("a"), F.sum(1 - F.col("up")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    z = (F.col("runs") - (2 * a * b / (a + b) + 1)) / F.sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)))
    return c.select("runs", _r(z, 5).alias("z"), _r(2 * (1 - stats.normal_cdf(F.abs(z))), 5).alias("p_value"))


@query(_with(""", s AS (SELECT idx, sign(draw - lag(draw) OVER (ORDER BY idx)) AS d FROM draws), t AS (SELECT idx, d, CASE WHEN d = lag(d) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM s WHERE d IS NOT NULL),
i AS (SELECT d, sum(ch) OVER (ORDER BY idx) AS isl FROM t), g AS (SELECT isl, any_value(d) AS d, count(*) AS n FROM i GROUP BY isl) SELECT CAST(d AS INTEGER) AS direction, n AS length, count(*) AS runs FROM g GROUP BY ALL"""))
def monotone_runs(spark, folder):
    """Lengths of rising, falling and level runs."""
    x = W.lagged(draws(spark, folder).select("idx", "draw"), "draw", [1]).where("draw_lag1 IS NOT NULL").select("idx", F.signum(F.col("draw") - F.col("draw_lag1")).cast("int").alias("direction"))
    return W.islands(x, "direction").groupBy("direction", "length").agg(F.count(F.lit(1)).alias("runs"))


@query(_with(""", g AS (SELECT abs(draw - lag(draw) OVER (ORDER BY idx)) % 1000 AS g FROM draws) SELECT CAST(trunc(quantile_cont(g, 0.05)) AS INTEGER) AS p5, CAST(trunc(quantile_cont(g, 0.95)) AS INTEGER) AS p95, count(DISTINCT g) AS distinct_gaps FROM g"""))
def difference_percentiles(spark, folder):
    """5th and 95th percentile of differences, interpolated, then cut to whole numbers."""
    g = W.lagged(draws(spark, folder).select("idx", "draw"), "draw", [1]).select((F.abs(F.col("draw") - F.col("draw_lag1")) % 1000).alias("g"))
    return g.agg(F.percentile("g", 0.05).cast("int").alias("p5"), F.percentile("g", 0.95).cast("int").alias("p95"), F.count_distinct("g").alias("distinct_gaps"))


@query(_with(""" SELECT session, count(*) AS n, round(avg(draw), 6) AS mean, round(stddev_samp(draw), 6) AS sd_sample, round(stddev_pop(draw), 6) AS sd_population, min(draw) AS lo, max(draw) AS hi, round(median(draw), 2) AS median FROM draws GROUP BY session"""))
def descriptive(spark, folder):
    """Moments and order statistics per session."""
    return draws(spark, folder).groupBy("session").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("draw")).alias("mean"), _r(F.stddev_samp("draw")).alias("sd_sample"), _r(F.stddev_pop("draw")).alias("sd_population"), F.min("draw").alias("lo"), F.max("draw").alias("hi"), _r(F.median("draw"), 2).alias("median"))


@query(_with(""", c AS (SELECT draw, count(*) AS n, min(idx) AS f FROM draws GROUP BY draw) SELECT draw, n FROM c ORDER BY n DESC, f LIMIT 20"""))
def most_common(spark, folder):
    """The 20 most frequent draws; ties in the order of their first appearance."""
    return draws(spark, folder).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("f")).orderBy(F.desc("n"), "f").limit(20).select("draw", "n")


@query(_with(""", t AS (SELECT count(*) AS n FROM draws), p AS (SELECT row_number() OVER (ORDER BY idx) AS k, draw FROM draws) SELECT CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, CAST(sum(draw) AS BIGINT) AS total FROM p, t GROUP BY ALL"""))
def train_holdout_split(spark, folder):
    """The first four fifths against the rest, by position."""
    d = draws(spark, folder)
    x = W.row_index(d, "pos").crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))
    return x.groupBy(F.when(F.col("pos") + 1 <= F.floor(F.col("n") * 0.8), "train").otherwise("holdout").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("draw").alias("total"))


@query(_with(""" SELECT CAST(abs(CAST('0x' || substr(md5(CAST(idx AS VARCHAR)), 1, 8) AS BIGINT)) % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(draw) AS BIGINT) AS total FROM draws GROUP BY ALL"""))
def hash_folds(spark, folder):
    """Five folds by a hash of the position: the same for any partitioning."""
    h = F.conv(F.substring(F.md5(F.col("idx").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return draws(spark, folder).groupBy((h % 5).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("draw").alias("total"))


@query("""SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_last_hour FROM events""")
def trailing_hour_count(spark, folder):
    """Events of the same type in the hour up to each."""
    e = table(spark, folder, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("event_type").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_type", "event_id", F.count(F.lit(1)).over(w).alias("in_last_hour"))


@query("""WITH h AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY event_id) AS half FROM events), a AS (SELECT event_type, avg(value) FILTER (half = 1) AS a, avg(value) FILTER (half = 2) AS b FROM h GROUP BY event_type)
SELECT event_type, round((b - a) / a * 100, 4) AS change_percent FROM a""")
def half_split_trend(spark, folder):
    """Change of the mean from the first half to the second, in percent."""
    e = table(spark, folder, "events")
    h = e.select("event_type", "value", F.ntile(2).over(Window.partitionBy("event_type").orderBy("event_id")).alias("half"))
    a = h.groupBy("event_type").agg(F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("b"))
    return a.select("event_type", _r((F.col("b") - F.col("a")) / F.col("a") * 100, 4).alias("change_percent"))


@query("""SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS d) s LEFT JOIN (SELECT CAST(ts AS DATE) AS k, count(*) AS n FROM events GROUP BY 1) c ON c.k = CAST(s.d AS DATE)""")
def date_series(spark, folder):
    """Every day from the first to the last, with its events, none left out."""
    c = table(spark, folder, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = c.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(c, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(_with(""", m AS (SELECT idx, CAST(draw % 5 = 0 AS INT) AS hit FROM draws), g AS (SELECT idx, hit, sum(hit) OVER (ORDER BY idx) AS k FROM m) SELECT idx, CAST(sum(1 - hit) OVER (PARTITION BY k ORDER BY idx) AS BIGINT) AS misses FROM g"""))
def consecutive_misses(spark, folder):
    """Misses since the last hit, at every position."""
    m = draws(spark, folder).select("idx", (F.col("draw") % 5 == 0).cast("bigint").alias("hit"))
    g = W.running_sum(m, F.col("hit"), "k")
    w = Window.partitionBy("k").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("idx", F.sum(1 - F.col("hit")).over(w).alias("misses"))


@query(_with(""", t AS (SELECT max(idx) AS last FROM draws), w AS (SELECT (last - idx) // 250 AS age, draw FROM draws, t WHERE last - idx < 1000), s AS (SELECT DISTINCT age, draw FROM w)
SELECT a.age AS age, count(*) AS overlap, round(count(*) / 1000.0, 6) AS share FROM s a JOIN s b ON b.age = a.age + 1 AND b.draw = a.draw GROUP BY a.age"""))
def window_overlap(spark, folder):
    """Values that neighbouring trailing windows of 250 draws share."""
    d = draws(spark, folder)
    w = d.crossJoin(F.broadcast(d.agg(F.max("idx").alias("last")))).where("last - idx < 1000").select(F.floor((F.col("last") - F.col("idx")) / 250).alias("age"), "draw").distinct()
    b = w.select((F.col("age") - 1).alias("age"), "draw")
    return w.join(b, ["age", "draw"]).groupBy("age").agg(F.count(F.lit(1)).alias("overlap"), _r(F.count(F.lit(1)) / 1000.0).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
