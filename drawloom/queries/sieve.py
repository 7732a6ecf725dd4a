"""Queries of the seed sieve, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators import generators as G
from drawloom.operators import sieve as S
from drawloom.operators import windows as W
from drawloom.sources.tables import DRAWS_SQL, draws, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, N, SKIPS, T = 8, 30_000, (0, 10), 1 / 8


def window_values(spark: SparkSession, folder: str, k: int = K) -> list[int]:
    """The k values of the window that the sieve is for; they become literals."""
    return [r.draw for r in W.window_scan(draws(spark, folder), k).orderBy("pos").select("draw").collect()]


def _pass(spark, folder, family="java_lcg", reverse=False, n=N, threshold=T):  # noqa: ANN001, ANN202
    return S.fixed_skip(S.seed_space(spark, 0, n), window_values(spark, folder), family, SKIPS, threshold, reverse=reverse)


def _steps_sql(family: str) -> str:
    at = {s: S.positions(K, s) for s in range(SKIPS[0], SKIPS[1] + 1)}
    jump = G.jumps(G.FAMILIES[family].affine, [p for ps in at.values() for p in ps])
    return ", ".join(f"({s}, {i}, {jump[p][0]}, {jump[p][1]})" for s, ps in at.items() for i, p in enumerate(ps))


def _sieve_cte(family: str, reverse: bool, name: str, n: int = N, threshold: float = T) -> str:
    _, _, m, shift = G.FAMILIES[family].affine
    i = f"{K - 1} - s.i" if reverse else "s.i"
    seed = {"minstd": f"CASE WHEN q.seed % {m} = 0 THEN 1 ELSE q.seed % {m} END"}.get(family, "q.seed")
    out = f"CAST(((CAST({seed} AS HUGEINT) * s.a + s.c) % {m}) AS BIGINT) >> {shift}"
    return f"""{name}_st(skip, i, a, c) AS (VALUES {_steps_sql(family)}),
{name}_m AS (SELECT q.seed, s.skip, sum(CAST((({out}) & 4294967295) % 1000 = d.draw % 1000 AS INT)) AS n FROM range({n}) q(seed) CROSS JOIN {name}_st s JOIN draws d ON d.idx = {i} GROUP BY q.seed, s.skip),
{name} AS (SELECT seed, CAST(max(n) AS INTEGER) AS matches, {K} AS total, max(n) / {K} AS match_rate, CAST(CASE WHEN max(n) > 0 THEN -max(n * 4096 - skip) + max(n) * 4096 ELSE 0 END AS INTEGER) AS best_skip FROM {name}_m GROUP BY seed HAVING max(n) >= {S.least_matches(threshold, K)})"""


def query(sql: str | None = None):  # noqa: ANN201
    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


#: Families whose reverse pass burns nothing between values.
_NO_BURN = ("xoshiro256pp", "sfc64")
_M32, _M64 = "4294967295::UBIGINT", "18446744073709551615::UHUGEINT"
_rot = lambda x, k: f"((({x} << {k}) & {_M64}) | ({x} >> {64 - k}))"
_GOLD, _SQ2, _SQ3 = "11400714819323198485::UHUGEINT", "7640891576956012808::UHUGEINT", "13503953896175478587::UHUGEINT"


def _philox_sql() -> list[str]:
    """Ten rounds as nested selects."""
    out = [f"SELECT seed, p + 1 AS p, n + 1 AS n, n AS a, 0::UHUGEINT AS b, 0::UHUGEINT AS c, 0::UHUGEINT AS d, seed & {_M32} AS k, seed >> 32 AS l FROM @"]
    for _ in range(10):
        p, q = "(a * 3528531795::UHUGEINT)", "(c * 3449720151::UHUGEINT)"
        out.append(f"SELECT seed, p, n, xor(xor({q} >> 32, b), k) AS a, {q} & {_M32} AS b, xor(xor({p} >> 32, d), l) AS c, {p} & {_M32} AS d, (k + 2654435769) & {_M32} AS k, (l + 3144134277) & {_M32} AS l FROM @")
    return [*out, "SELECT seed, p, n, a AS x FROM @"]


#: Generators as recursive queries: state columns with their start, then selects, one inside the other, of which the last gives seed, p, the state and the output x.
_STEPS = {
    "xorshift32": ({"y": f"range & {_M32}"}, [f"SELECT seed, p, xor(y, (y << 13) & {_M32}) AS y FROM @", "SELECT seed, p, xor(y, y >> 17) AS y FROM @", f"SELECT seed, p + 1 AS p, xor(y, (y << 5) & {_M32}) AS y, xor(y, (y << 5) & {_M32}) AS x FROM @"]),
    "xorshift128": ({"a": f"range & {_M32}", "b": "362436069", "c": "521288629", "d": "88675123"}, [f"SELECT seed, p + 1 AS p, xor(a, (a << 11) & {_M32}) AS t, b, c, d FROM @", "SELECT seed, p, b AS a, c AS b, d AS c, xor(xor(d, d >> 19), xor(t, t >> 8)) AS d FROM @", "SELECT *, d AS x FROM @"]),
    "xorshift64": ({"y": "range"}, ["SELECT seed, p, xor(y, y >> 12) AS y FROM @", f"SELECT seed, p, xor(y, (y << 25) & {_M64}) AS y FROM @", "SELECT seed, p, xor(y, y >> 27) AS y FROM @", f"SELECT seed, p + 1 AS p, (y * 2685821657736338717::UHUGEINT) & {_M64} AS y FROM @", "SELECT *, y AS x FROM @"]),
    "pcg32": ({"y": "range"}, [f"SELECT seed, p + 1 AS p, (y * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) & {_M64} AS y, (xor(y >> 18, y) >> 27) & {_M32} AS v, (y >> 59) & 31::UHUGEINT AS r FROM @", f"SELECT seed, p, y, ((v >> r) | (v << ((32::UHUGEINT - r) & 31::UHUGEINT))) & {_M32} AS x FROM @"]),
    "xoshiro256pp": ({"a": "range", "b": _GOLD, "c": _SQ2, "d": _SQ3}, [f"SELECT *, (a + d) & {_M64} AS s, xor(c, a) AS e, xor(d, b) AS f FROM @", f"SELECT seed, p + 1 AS p, xor(a, f) AS a, xor(b, e) AS b, xor(e, (b << 17) & {_M64}) AS c, {_rot('f', 45)} AS d, ({_rot('s', 23)} + a) & {_M64} AS x FROM @"]),
    "sfc64": ({"a": "range", "b": _GOLD, "c": _SQ2, "n": "1"}, [f"SELECT seed, p, a, b, c, n, (a + b + n) & {_M64} AS x FROM @", f"SELECT seed, p + 1 AS p, xor(b, b >> 11) AS a, (c + ((c << 3) & {_M64})) & {_M64} AS b, ({_rot('c', 24)} + x) & {_M64} AS c, n + 1 AS n, x FROM @"]),
    "philox4x32": ({"n": "0"}, _philox_sql()),
}


def _stepped_sql(family: str, reverse: bool) -> str:
    burn = not (reverse and family in _NO_BURN)
    at = [(s, i, p) for s in range(SKIPS[0], SKIPS[1] + 1) for i, p in enumerate(S.positions(K, s, burn_between=burn))]
    state, steps = _STEPS[family]
    q = f"(SELECT * FROM s WHERE p < {max(p for *_, p in at)})"
    for step in steps:
        q = "(" + step.replace("@", q) + ")"
    cols = ", ".join(state)
    i = f"{K - 1} - t.i" if reverse else "t.i"
    return f"""WITH RECURSIVE {DRAWS_SQL}, s AS (SELECT range::UHUGEINT AS seed, 0 AS p, {', '.join(f'({v})::UHUGEINT AS {c}' for c, v in state.items())}, 0::UHUGEINT AS x FROM range({N}) UNION ALL SELECT seed, p, {cols}, x FROM {q}),
t(skip, i, p) AS (VALUES {', '.join(map(str, at))}), m AS (SELECT s.seed, t.skip, sum(CAST(s.x % 1000 = d.draw AS INT)) AS n FROM t JOIN s ON s.p = t.p JOIN draws d ON d.idx = {i} GROUP BY ALL)
SELECT CAST(seed AS BIGINT) AS seed, CAST(max(n) AS INTEGER) AS matches, {K} AS total, max(n) / {K} AS match_rate, CAST(-max(n * 4096 - skip) + max(n) * 4096 AS INTEGER) AS best_skip FROM m GROUP BY seed HAVING max(n) >= {S.least_matches(T, K)}"""


def _register_sieves() -> None:
    for family in ("java_lcg", "minstd", "lcg32"):
        for rev in (False, True):
            name = f"sieve_{family}{'_reverse' if rev else ''}"
            QUERIES[name] = lambda spark, folder, f=family, r=rev: _pass(spark, folder, f, r)
            SQL[name] = f"WITH {DRAWS_SQL}, {_sieve_cte(family, rev, 'sv')} SELECT * FROM sv"
    for family in G.FAMILIES:
        if not G.FAMILIES[family].affine:
            QUERIES[f"sieve_{family}"] = lambda spark, folder, f=family: _pass(spark, folder, f)
            QUERIES[f"sieve_{family}_reverse"] = lambda spark, folder, f=family: S.fixed_skip(
                S.seed_space(spark, 0, N), window_values(spark, folder), f, SKIPS, T, reverse=True, burn_between=f not in _NO_BURN
            )
            if family in _STEPS:
                SQL[f"sieve_{family}"], SQL[f"sieve_{family}_reverse"] = _stepped_sql(family, False), _stepped_sql(family, True)


_register_sieves()
_BOTH = f"WITH {DRAWS_SQL}, {_sieve_cte('java_lcg', False, 'f')}, {_sieve_cte('java_lcg', True, 'r')}"


@query(f"{_BOTH} SELECT seed, f.match_rate AS forward_match_rate, f.best_skip AS forward_skip, r.match_rate AS reverse_match_rate, r.best_skip AS reverse_skip, (f.match_rate + r.match_rate) / 2 AS score FROM f JOIN r USING (seed)")
def bidirectional_survivors(spark, folder):
    """Seeds that survive both passes."""
    return S.bidirectional(_pass(spark, folder), _pass(spark, folder, reverse=True))


@query(f"""{_BOTH}, c AS (SELECT CAST((SELECT count(*) FROM f) AS DOUBLE) AS f, CAST((SELECT count(*) FROM r) AS DOUBLE) AS r, CAST((SELECT count(*) FROM f JOIN r USING (seed)) AS DOUBLE) AS b)
SELECT CAST(f AS BIGINT) AS forward_count, CAST(r AS BIGINT) AS reverse_count, CAST(b AS BIGINT) AS bidirectional_count, CAST(f - b AS BIGINT) AS forward_only_count, CAST(r - b AS BIGINT) AS reverse_only_count,
 b / (f + r - b) AS jaccard, b / greatest(f + r - b, 1) AS intersection_ratio, b / greatest(f, 1) AS survivor_overlap_ratio, f / greatest(r, 1) AS bidirectional_selectivity, b / greatest(f + r, 1) AS intersection_weight, b / f AS precision, b / r AS recall FROM c""")
def trial_summary(spark, folder):
    """Counts and ratios of a trial."""
    return S.trial_summary(_pass(spark, folder), _pass(spark, folder, reverse=True))


@query(f"{_BOTH} SELECT 'forward_only' AS side, seed FROM f ANTI JOIN r USING (seed) UNION ALL SELECT 'reverse_only', seed FROM r ANTI JOIN f USING (seed)")
def one_sided_survivors(spark, folder):
    """Seeds of one pass only."""
    f, r = _pass(spark, folder), _pass(spark, folder, reverse=True)
    return f.join(r, "seed", "left_anti").select(F.lit("forward_only").alias("side"), "seed").unionByName(r.join(f, "seed", "left_anti").select(F.lit("reverse_only").alias("side"), "seed"))


@query(f"{_BOTH} SELECT seed FROM f INTERSECT SELECT seed FROM r")
def survivor_intersection(spark, folder):
    """INTERSECT of both passes."""
    return _pass(spark, folder).select("seed").intersect(_pass(spark, folder, reverse=True).select("seed"))


@query(f"{_BOTH}, u AS (SELECT seed, match_rate, best_skip, 1 AS o FROM f UNION ALL SELECT seed, match_rate, best_skip, 0 FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY match_rate DESC, o DESC) AS n FROM u) SELECT seed, match_rate, best_skip FROM k WHERE n = 1")
def survivor_accumulation(spark, folder):
    """Upsert of the reverse pass into the forward one; the higher rate wins, the stored row on ties."""
    cols = ["seed", "match_rate", "best_skip"]
    return S.accumulate(_pass(spark, folder).select(*cols), _pass(spark, folder, reverse=True).select(*cols), score="match_rate")


@query(f"WITH {DRAWS_SQL}, {_sieve_cte('java_lcg', False, 'f', threshold=2 / 8)}, {_sieve_cte('minstd', False, 'g', threshold=2 / 8)} SELECT 'constant' AS skip_mode, 'java_lcg' AS family, seed, match_rate FROM f UNION ALL SELECT 'constant', 'minstd', seed, match_rate FROM g")
def family_union(spark, folder):
    """Results of several families, tagged."""
    out = None
    for f in ("java_lcg", "minstd"):
        d = _pass(spark, folder, f, threshold=2 / 8).select(F.lit("constant").alias("skip_mode"), F.lit(f).alias("family"), "seed", "match_rate")
        out = d if out is None else out.unionByName(d)
    return out


@query(f"WITH {DRAWS_SQL}, {_sieve_cte('java_lcg', False, 'f', threshold=2 / 8)}, g AS (SELECT seed - lag(seed) OVER (ORDER BY seed) AS gap FROM f) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")
def survivor_gaps(spark, folder):
    """Distances between neighbouring survivors, counted. Survivors are ranked in blocks, so no window holds all."""
    s = W.row_index(_pass(spark, folder, threshold=2 / 8).select("seed"), "pos", "seed")
    x = W.lagged(s, "seed", [1], "pos").where("seed_lag1 IS NOT NULL")
    return x.groupBy((F.col("seed") - F.col("seed_lag1")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DRAWS_SQL}, {_sieve_cte('java_lcg', False, 'f', threshold=2 / 8)}, b AS (SELECT min(seed) AS a, max(seed) AS b FROM f) SELECT count(*) AS n, min(range) AS lo, max(range) AS hi FROM range({N}), b WHERE range BETWEEN a AND b")
def phase_two_range(spark, folder):
    """The range that a second phase would scan."""
    s = _pass(spark, folder, threshold=2 / 8).agg(F.min("seed").alias("a"), F.max("seed").alias("b"))
    x = S.seed_space(spark, 0, N).join(F.broadcast(s), F.col("seed").between(F.col("a"), F.col("b")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("lo"), F.max("seed").alias("hi"))


PLANTED, HYBRID_N = 1235, 4_000
#: Skips before each planted value: constant, and varying around five.
SAME, VARYING = [3] * K, [5, 6, 5, 4, 5, 5, 6, 5]


@query(" UNION ALL ".join(f"SELECT '{f}' AS family, {r} AS reverse, CAST({PLANTED} AS BIGINT) AS seed, {K} AS matches, 3 AS best_skip" for f in G.FAMILIES for r in ("FALSE", "TRUE")))
def planted_sieves(spark, folder):
    """A planted seed is all that every family's forward and reverse sieve finds at a threshold of 1."""
    out = None
    for f in G.FAMILIES:
        for rev in (False, True):
            burn = not (rev and f in _NO_BURN)
            v = S.planted(f, PLANTED, SAME if burn else [3] + [0] * (K - 1))
            d = S.fixed_skip(S.seed_space(spark, 0, N), v[::-1] if rev else v, f, SKIPS, 1.0, reverse=rev, burn_between=burn).select(F.lit(f).alias("family"), F.lit(rev).alias("reverse"), "seed", "matches", "best_skip")
            out = d if out is None else out.unionByName(d)
    return out


@query(" UNION ALL ".join(f"SELECT '{f}' AS family, {r} AS reverse, CAST({PLANTED} AS BIGINT) AS seed, {K} AS matches, 0 AS strategy_id" for f in G.FAMILIES for r in ("FALSE", "TRUE")))
def planted_hybrids(spark, folder):
    """A seed planted with varying skips is all that every family's hybrid and hybrid reverse sieve finds at a threshold of 1."""
    out = None
    for f in G.FAMILIES:
        seeds = S.seed_space(spark, 0, HYBRID_N)
        fwd = S.hybrid(seeds, S.planted(f, PLANTED, VARYING, hybrid=True), f, 1.0)
        rev = S.hybrid_reverse(seeds, S.planted(f, PLANTED, [x - 4 for x in VARYING])[::-1], f, 1.0)
        for d, r in ((fwd, False), (rev, True)):
            d = d.select(F.lit(f).alias("family"), F.lit(r).alias("reverse"), "seed", "matches", "strategy_id")
            out = d if out is None else out.unionByName(d)
    return out


@query(f"SELECT CAST({PLANTED} AS BIGINT) AS seed, {K} AS matches, [{', '.join(map(str, VARYING))}] AS skip_pattern")
def hybrid_two_phase(spark, folder):
    """Fixed skips first, variable skips on the survivors: a planted seed that the first phase lets through for the second one."""
    v = S.planted("java_lcg", PLANTED, VARYING, hybrid=True)
    return S.two_phase(S.seed_space(spark, 0, N), v, "java_lcg", SKIPS, 0.2, 0.75).select("seed", "matches", "skip_pattern")


def _digit_sql(n: int, lo: int, hi: int) -> str:
    at = [(s, i, d, s + i * (3 + s) + d + 1) for s in range(lo, hi + 1) for i in range(K) for d in range(3)]
    jump = G.jumps(G.FAMILIES["java_lcg"].affine, [p for *_, p in at])
    vals = ", ".join(f"({s}, {i}, {d}, {jump[p][0]}, {jump[p][1]})" for s, i, d, p in at)
    out = "(CAST(((CAST(q.seed AS HUGEINT) * s.a + s.c) % 281474976710656) AS BIGINT) >> 16) & 4294967295"
    return f"""WITH {DRAWS_SQL}, st(skip, i, d, a, c) AS (VALUES {vals}),
h AS (SELECT q.seed, s.skip, s.i, sum(CAST(({out}) % 10 = CASE s.d WHEN 0 THEN w.draw // 100 WHEN 1 THEN w.draw // 10 % 10 ELSE w.draw % 10 END AS INT)) AS n FROM range({n}) q(seed) CROSS JOIN st s JOIN draws w ON w.idx = s.i GROUP BY ALL),
r AS (SELECT seed, skip, sum(CAST(n = 3 AS INT)) AS f, sum(CAST(n >= 2 AS INT)) AS p FROM h GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY p * {K + 1} + f DESC, skip) AS rn FROM r)
SELECT seed, CAST(f AS INTEGER) AS full_matches, CAST(p AS INTEGER) AS partial_matches, CAST(skip AS INTEGER) AS best_skip FROM k WHERE rn = 1"""


@query(_digit_sql(N, 0, 5))
def digit_sequential_sieve(spark, folder):
    """Three outputs a value, digit by digit."""
    return S.digit_sequential(S.seed_space(spark, 0, N), window_values(spark, folder), "java_lcg", (0, 5))


_PILOTS = ", ".join(f"({p - 1}, {a}, {c})" for p, (a, c) in G.jumps(G.FAMILIES["java_lcg"].affine, list(range(1, K + 1))).items())


@query(f"""WITH {DRAWS_SQL}, st(i, a, c) AS (VALUES {_PILOTS}), m AS (SELECT q.range * 7812 AS seed, avg(CAST(((CAST(((CAST(q.range * 7812 AS HUGEINT) * st.a + st.c) % 281474976710656) AS BIGINT) >> 16) & 4294967295) % 1000 = d.draw AS INT)) AS r FROM range(128) q, st JOIN draws d ON d.idx = st.i GROUP BY 1),
t AS (SELECT count(*) AS pilots, avg(r) AS mean, stddev_pop(r) AS sd, max(r) AS top FROM m), o AS (SELECT *, greatest(0.005, least(0.25, mean + 3 * sd)) AS one FROM t)
SELECT pilots, round(mean, 9) AS mean, round(sd, 9) AS sd, round(one, 3) AS phase1, round(greatest(0.6, least(0.9, greatest(one + 0.25, CASE WHEN top > one THEN top * 0.85 ELSE one + 0.25 END))), 3) AS phase2 FROM o""")
def adaptive_thresholds(spark, folder):
    """Thresholds of both phases from pilot seeds."""
    return S.adaptive_threshold(0, 1_000_000, window_values(spark, folder), "java_lcg", spark).withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


@query("SELECT f || k AS generator, f AS family, b AS seed_bits, a AS affine, k LIKE '%reverse%' AS reverse, k LIKE '%hybrid%' AS hybrid FROM (VALUES ('xorshift32', 32, FALSE), ('java_lcg', 48, TRUE), ('minstd', 32, TRUE), ('xorshift128', 32, FALSE), ('xorshift64', 64, FALSE), ('pcg32', 64, FALSE), ('lcg32', 32, TRUE), ('xoshiro256pp', 64, FALSE), ('philox4x32', 64, FALSE), ('sfc64', 64, FALSE), ('mt19937', 32, FALSE)) f(f, b, a), (VALUES (''), ('_hybrid'), ('_reverse'), ('_hybrid_reverse')) k(k)")
def generator_catalogue(spark, folder):
    """The 44 kinds of generators."""
    return G.catalogue(spark)


@query(f"""WITH {DRAWS_SQL}, e AS (SELECT idx, draw, CAST(floor(epoch(CAST(date AS TIMESTAMP))) AS BIGINT) + CASE session WHEN 'midday' THEN 46800 ELSE 68400 END AS t FROM draws),
x AS (SELECT e.idx, e.draw, g.s AS seed FROM e, LATERAL (SELECT unnest(range(e.t - 300, e.t + 300)) AS s) g)
SELECT idx, seed FROM x WHERE ((CAST(((CAST(seed AS HUGEINT) * 25214903917 + 11) % 281474976710656) AS BIGINT) >> 16) & 4294967295) % 1000 = draw""")
def interval_seed_join(spark, folder):
    """For each draw, the seeds within 300 s of its time whose first output is the draw."""
    secs = F.unix_timestamp(F.col("date").cast("timestamp")) + F.when(F.col("session") == "midday", 46800).otherwise(68400)
    d = draws(spark, folder).withColumn("seed", F.explode(F.sequence(secs - 300, secs + 299)))
    a, c = G.jumps(G.FAMILIES["java_lcg"].affine, [1])[1]
    return d.where(G.affine_output("java_lcg", G.affine_seed("java_lcg", F.col("seed")), a, c) % 1000 == F.col("draw")).select("idx", "seed")


@query("SELECT u.unit AS unit, CAST(epoch_us(TIMESTAMP '2024-02-01 00:00:00') // u.div AS BIGINT) AS first_seed, CAST((epoch_us(TIMESTAMP '2024-02-02 00:00:00') - 1) // u.div AS BIGINT) AS last_seed FROM (VALUES ('us', 1), ('ms', 1000), ('s', 1000000), ('min', 60000000)) u(unit, div)")
def timestamp_span(spark, folder):
    """The seeds of a day in microseconds, milliseconds, seconds and minutes."""
    u = spark.createDataFrame([("us", 1), ("ms", 1000), ("s", 1000000), ("min", 60000000)], "unit string, div bigint")
    us = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    return u.select("unit", F.floor(us("2024-02-01 00:00:00") / F.col("div")).alias("first_seed"), F.floor((us("2024-02-02 00:00:00") - 1) / F.col("div")).alias("last_seed"))


@query("SELECT s.range AS seed FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) s ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') c ON c.l_orderkey = s.range")
def uncached_seeds(spark, folder):
    """Seeds of a range that no stored result has."""
    hi = table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0]
    done = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seed"))
    return S.seed_space(spark, 0, hi + 1).join(done, "seed", "left_anti")


@query("WITH s AS (SELECT o_orderkey AS s FROM orders), v AS (SELECT s, CAST(s % 8 < 3 AS INT) + CAST(s % 125 < 40 AS INT) + CAST(s % 1000 < 400 AS INT) AS votes FROM s) SELECT votes, count(*) AS n, CAST(sum(s) AS BIGINT) AS total FROM v WHERE votes >= 2 GROUP BY votes")
def vote_predicate(spark, folder):
    """Seeds that at least two of three residue tests take."""
    s = table(spark, folder, "orders").select(F.col("o_orderkey").alias("s"))
    v = sum((F.col("s") % m < o).cast("int") for m, o in ((8, 3), (125, 40), (1000, 400)))
    return s.withColumn("votes", v).where("votes >= 2").groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))


@query("""WITH s AS (SELECT o_orderkey AS s, o_totalprice AS q FROM orders), g AS (SELECT *, (CAST(s % 8 < 3 AS INT) + CAST(s % 125 < 40 AS INT) + CAST(s % 1000 < 400 AS INT)) >= 2 AS inn, q > 250000 AS hit FROM s),
a AS (SELECT avg(CAST(hit AS INT)) FILTER (inn) AS ps, avg(CAST(hit AS INT)) AS pg, avg(CAST(inn AS INT)) AS cov FROM g) SELECT round(ln((ps + 1e-9) / (pg + 1e-9)), 6) AS enrichment, round(cov, 6) AS coverage, round(greatest(-1, least(1, 0.7 * tanh(ln((ps + 1e-9) / (pg + 1e-9))) + 0.2 * cov - 0.1 * least(1, cov / 0.4))), 6) AS objective FROM a""")
def enrichment(spark, folder):
    """How much likelier hits are among the seeds that the vote takes."""
    g = table(spark, folder, "orders").select((sum((F.col("o_orderkey") % m < o).cast("int") for m, o in ((8, 3), (125, 40), (1000, 400))) >= 2).alias("inn"), (F.col("o_totalprice") > 250000).cast("int").alias("hit"))
    a = g.agg(F.avg(F.when(F.col("inn"), F.col("hit"))).alias("ps"), F.avg("hit").alias("pg"), F.avg(F.col("inn").cast("int")).alias("cov"))
    e = F.ln((F.col("ps") + 1e-9) / (F.col("pg") + 1e-9))
    o = 0.7 * F.tanh(e) + 0.2 * F.col("cov") - 0.1 * F.least(F.lit(1.0), F.col("cov") / 0.4)
    return a.select(F.round(e, 6).alias("enrichment"), F.round(F.col("cov"), 6).alias("coverage"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), o)), 6).alias("objective"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

