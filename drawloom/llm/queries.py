"""The queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions.keys import key, key_sql
from drawloom.llm import distinct, packing, percentiles, pii, tokenize, topn
from drawloom.sources.tables import table
from drawloom.storage import written

PROBS = [0.5, 0.9, 0.95, 0.99]


def p1_distinct_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct seeds per day, generator, both, (generator, mapping) and month, each with its error bound.

    Sketches per (day, generator) and (generator, mapping) are made from one scan and written: the partial results. The other scopes
    are merges of them.
    """
    rows = table(spark, folder, "cache_results").select(F.date_format("computed_at", "yyyy-MM-dd").alias("day"), key("prng_type").alias("prng_type"), "mapping_type", "seed")
    dims = ["day", "prng_type", "mapping_type"]
    s = written(distinct.sketch(rows, "seed", [["day", "prng_type"], ["prng_type", "mapping_type"]], dims), "sketches")
    day, gen, known = F.col("day"), F.col("prng_type"), F.col("prng_type").isNotNull()
    daily = F.col("grouping") == 0
    merged = {"day": (daily, {"day": day}), "prng_type": (daily & known, {"prng_type": gen}), "month": (daily, {"day": F.substring("day", 1, 7)})}
    ready = {"day_prng_type": (daily & known, {"day": day, "prng_type": gen}), "prng_type_mapping": (~daily & known, {"prng_type": gen, "mapping_type": F.col("mapping_type")})}
    return _estimates(s, merged, ready, dims)


def _estimates(s: DataFrame, merged: dict, ready: dict, dims: list[str]) -> DataFrame:
    """Estimates of scopes that are merges of the sketches and of those that are there already."""
    by = ["scope", *dims]
    return distinct.estimate(distinct.merge(distinct.scoped(s, merged, dims), by).unionByName(distinct.scoped(s, ready, dims)), by)


def p1_distinct_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct studies per day, per generator and per both."""
    rows = table(spark, folder, "step1_trial_history").select(F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), key("prng_type").alias("prng_type"), "study_name")
    dims = ["day", "prng_type"]
    s = written(distinct.sketch(rows, "study_name", [dims], dims), "sketches")
    day, gen, known, every = F.col("day"), F.col("prng_type"), F.col("prng_type").isNotNull(), F.lit(True)
    return _estimates(s, {"day": (every, {"day": day}), "prng_type": (known, {"prng_type": gen})}, {"day_prng_type": (known, {"day": day, "prng_type": gen})}, dims)


def _p1_sql(source: str, ident: str, scopes: dict[str, tuple[list[str], str]], dims: list[str]) -> str:
    """The same bits counted as distinct (level, place) pairs."""
    parts = []
    for name, (cols, cond) in scopes.items():
        sel = ", ".join(f"{'d.' + c if c in cols else 'NULL'} AS {c}" for c in dims)
        grp = ", ".join(f"d.{c}" for c in cols)
        parts.append(f"SELECT '{name}' AS scope, {sel}, d.lv, count(DISTINCT d.place) AS ones FROM {'m' if name == 'month' else 'x'} d WHERE {cond} GROUP BY {grp}, d.lv")
    b = distinct.BITS
    return f"""WITH r AS ({source}), h AS (SELECT *, CAST('0x' || substr(md5(CAST({ident} AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM r WHERE {ident} IS NOT NULL),
x AS (SELECT *, least({distinct.LEVELS - 1}, 36 - length(bin(h >> 24))) AS lv, h & {b - 1} AS place FROM h),
m AS (SELECT * REPLACE (substr(day, 1, 7) AS day) FROM x),
o AS ({' UNION ALL '.join(parts)}),
t AS (SELECT *, least(coalesce(max(CASE WHEN ones > {distinct.FULL} THEN lv END) OVER (PARTITION BY scope, {', '.join(dims)}), -1) + 1, {distinct.LEVELS - 1}) AS base FROM o),
e AS (SELECT *, -ln(1 - least(CAST(ones AS DOUBLE), {b - 0.5}) / {b}) AS rho FROM t WHERE lv >= base),
s AS (SELECT scope, {', '.join(dims)}, base, sum(rho) * {b} AS part, sum(exp(rho) - rho - 1) * {b} AS noise FROM e GROUP BY ALL)
SELECT scope, {', '.join(dims)}, CAST(round(part * pow(2.0, base)) AS BIGINT) AS n_distinct, round(3 * sqrt(noise + part * (1 - 1 / pow(2.0, base))) / part, 4) AS err_bound FROM s"""


P1_SEEDS_SQL = _p1_sql(
    f"SELECT strftime(computed_at, '%Y-%m-%d') AS day, {key_sql('prng_type')} AS prng_type, mapping_type, seed FROM cache_results",
    "seed",
    {"day": (["day"], "TRUE"), "prng_type": (["prng_type"], "prng_type IS NOT NULL"), "day_prng_type": (["day", "prng_type"], "prng_type IS NOT NULL"), "prng_type_mapping": (["prng_type", "mapping_type"], "prng_type IS NOT NULL"), "month": (["day"], "TRUE")},
    ["day", "prng_type", "mapping_type"],
)
P1_STUDIES_SQL = _p1_sql(
    f"SELECT strftime(recorded_at, '%Y-%m-%d') AS day, {key_sql('prng_type')} AS prng_type, study_name FROM step1_trial_history",
    "study_name",
    {"day": (["day"], "TRUE"), "prng_type": (["prng_type"], "prng_type IS NOT NULL"), "day_prng_type": (["day", "prng_type"], "prng_type IS NOT NULL")},
    ["day", "prng_type"],
)

_P2_DIMS = ["day", "node_id", "prng_type"]
_P2_SCOPES = {"node": ["node_id"], "prng_type": ["prng_type"], "node_prng_type": ["node_id", "prng_type"], "day": ["day"]}


def _runtimes(spark: SparkSession, folder: str) -> DataFrame:
    """A row that repeats an id was delivered twice and counts once."""
    rows = table(spark, folder, "cache_results").select("id", "computed_at", "node_id", "prng_type", "runtime").dropDuplicates(["id"])
    return rows.select(F.date_format("computed_at", "yyyy-MM-dd").alias("day"), "node_id", key("prng_type").alias("prng_type"), "runtime")


def _scope_rows(d: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once per scope of ``_P2_SCOPES``, with the columns of the others null; rows with a null key leave that scope."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), *((F.col(c) if c in cols else F.lit(None).cast("string")).alias(c) for c in _P2_DIMS)) for s, cols in _P2_SCOPES.items())))
    out = d.select(each.alias("g"), *keep).select("g.*", *keep)
    ok = F.lit(True)
    for s, cols in _P2_SCOPES.items():
        for c in cols:
            ok &= (F.col("scope") != s) | F.col(c).isNotNull()
    return out.where(ok)


def _p2_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Digests per (day, node, generator), merged by node addition to each scope, compressed again, then queried."""
    base = percentiles.digest(_runtimes(spark, folder), "runtime", _P2_DIMS)
    return percentiles.quantiles(_scope_rows(base, ["node", "n"]), ["scope", *_P2_DIMS], PROBS)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of runtime per node, generator, both and day, with the guaranteed rank error."""
    q = _p2_estimates(spark, folder)
    return q.select("scope", *_P2_DIMS, "n", "rank_error", *(percentiles.value_of(F.col(percentiles.leaf_name(p))).alias(f"p{round(p * 100)}") for p in PROBS))


def p2_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile held against the exact ranks of all rows: n, and whether each lies within the stated bounds."""
    dims = ["scope", *_P2_DIMS]
    q = _p2_estimates(spark, folder)
    on = [F.col(f"e.{d}").eqNullSafe(F.col(f"r.{d}")) for d in dims]
    rows = _scope_rows(_runtimes(spark, folder).where("runtime IS NOT NULL AND NOT isnan(runtime)"), ["runtime"])
    counts = rows.groupBy(*dims, "runtime").agg(F.count(F.lit(1)).alias("c"))
    j = counts.alias("r").join(q.alias("e"), on)
    aggs, oks = [F.sum("r.c").alias("n"), F.first("e.rank_error").alias("rank_error")], []
    for p in PROBS:
        x = f"{round(p * 100)}"
        lo, hi = percentiles.edges(F.col(f"e.{percentiles.leaf_name(p)}"))
        aggs += [F.sum(F.when(F.col("r.runtime") < lo, F.col("r.c")).otherwise(0)).alias(f"b{x}"), F.sum(F.when(F.col("r.runtime") <= hi, F.col("r.c")).otherwise(0)).alias(f"t{x}")]
        rank = F.ceil(F.col("n") * p)
        oks.append(((F.col(f"b{x}") - F.col("rank_error") < rank) & (F.col(f"t{x}") + F.col("rank_error") >= rank)).alias(f"ok{x}"))
    return j.groupBy(*(F.col(f"r.{d}") for d in dims)).agg(*aggs).select(*dims, "n", *oks)


P2_RANK_SQL = (
    f"WITH r AS (SELECT strftime(computed_at, '%Y-%m-%d') AS day, node_id, {key_sql('prng_type')} AS prng_type FROM (SELECT DISTINCT ON (id) * FROM cache_results) WHERE runtime IS NOT NULL AND NOT isnan(runtime)) "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS scope, {', '.join((c if c in cols else 'CAST(NULL AS VARCHAR)') + ' AS ' + c for c in _P2_DIMS)}, count(*) AS n, TRUE AS ok50, TRUE AS ok90, TRUE AS ok95, TRUE AS ok99 FROM r WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)}"
        for s, cols in _P2_SCOPES.items()
    )
)


def p2_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per scope: digests, values, whether each digest keeps to 3 k nodes and a root's path, and whether some were compressed (have nodes above the leaves)."""
    fits = F.col("nodes") <= 3 * percentiles.K + percentiles.LOG_U
    return _p2_estimates(spark, folder).groupBy("scope").agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("n_values"), F.min(fits).alias("bounded"), (F.max("inner") > 0).alias("compressed"))


P2_DIGESTS_SQL = f"SELECT scope, count(*) AS digests, CAST(sum(n) AS BIGINT) AS n_values, TRUE AS bounded, max(n) >= {percentiles.K} AS compressed FROM ({P2_RANK_SQL}) GROUP BY scope"


_P3 = (["prng_type", "seed"], "composite_score", "id", 3)
_P3_SAME = ["mapping_type", "samples", "parameter_hash"]


def _p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cache_results").select(key("prng_type").alias("prng_type"), "seed", "mapping_type", "samples", "parameter_hash", "composite_score", "id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three best results of every (generator, seed)."""
    return topn.top_n(_p3_rows(spark, folder), *_P3, same=_P3_SAME)


def p3_skipping(spark: SparkSession, folder: str) -> DataFrame:
    """Items written in clusters, and whether row groups and rows were left unread."""
    s = topn.skipping(_p3_rows(spark, folder), *_P3, same=_P3_SAME)
    return s.agg(F.sum("n_rows").alias("items"), (F.sum("groups_read") < F.sum("row_groups")).alias("groups_skipped"), (F.sum("rows_read") < F.sum("n_rows")).alias("rows_skipped"))


P3_SQL = f"""WITH c AS (SELECT {key_sql('prng_type')} AS prng_type, seed, mapping_type, samples, parameter_hash, composite_score, id FROM cache_results
 WHERE seed IS NOT NULL AND composite_score IS NOT NULL AND NOT isnan(composite_score)),
u AS (SELECT prng_type, seed, arg_min(composite_score, id) AS s, min(id) AS id FROM c WHERE prng_type IS NOT NULL GROUP BY prng_type, seed, mapping_type, samples, parameter_hash),
k AS (SELECT *, row_number() OVER (PARTITION BY prng_type, seed ORDER BY s DESC, id) AS rank_no FROM u)
SELECT prng_type, seed, CAST(rank_no AS INTEGER) AS rank_no, id FROM k WHERE rank_no <= 3"""


P3_SKIPPING_SQL = f"""SELECT count(*) AS items, TRUE AS groups_skipped, TRUE AS rows_skipped FROM (SELECT DISTINCT {key_sql('prng_type')} AS prng_type, seed, mapping_type, samples, parameter_hash FROM cache_results
 WHERE seed IS NOT NULL AND composite_score IS NOT NULL AND NOT isnan(composite_score) AND {key_sql('prng_type')} IS NOT NULL)"""


CAPACITY = 2048


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text."""
    return tokenize.encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, those of which the ids by trees are the ids of one encoding of the whole text and decode to it, and whether trees had joins to mend."""
    docs = table(spark, folder, "documents")
    return tokenize.held_against_whole(docs, "doc_id", "text")


P6_CHECK_SQL = "SELECT count(*) AS documents, count(*) AS equal, count(*) AS decoded, TRUE AS joined FROM documents"


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one above the capacity, with its container. Tokens are counted once and written; the number of groups follows the number of rows."""
    sizes = tokenize.encode(table(spark, folder, "documents"), "doc_id", "text", count_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("n_units", "n_tokens")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used against the least number that could hold all tokens, and the greatest and total load."""
    box = p7_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return box.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("load") / CAPACITY).alias("least"), F.max("load").alias("fullest"), F.sum("load").alias("tokens"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed, and whether no container is overfull, no document is cut that fits, cut ones give full pieces and a rest, and no
    more containers are used than the least possible and one a group."""
    p = p7_containers(spark, folder)
    docs = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.sum((F.col("n_tokens") == CAPACITY).cast("int")).alias("full"))
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.min((F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))) & (F.col("full") >= F.col("pieces") - 1)).alias("whole"))
    box = p.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    c = box.agg((F.max("load") <= CAPACITY).alias("fits"), (F.count(F.lit(1)) - F.ceil(F.sum("load") / CAPACITY) <= F.count_distinct(F.shiftright("container", 32))).alias("tight"))
    return d.crossJoin(F.broadcast(c)).select("documents", "whole", "fits", "tight")


P7_CHECK_SQL = "SELECT count(*) AS documents, TRUE AS whole, TRUE AS fits, TRUE AS tight FROM documents"


#: A key for tests; a deployment gives its own.
SECRET = "not a secret"


def _p8(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "documents"), "doc_id", "text", pii.lexicon(table(spark, folder, "name_parts"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per place with personal information, each of which has its surrogate."""
    return pii.replaced(*_p8(spark, folder), SECRET).select("doc_id", F.col("kind").alias("pii_kind"), "start_pos", "end_pos")


def p8_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in the place of personal information."""
    return pii.places(*_p8(spark, folder), mask=True).select("doc_id", F.col("masked").alias("text"))


def p8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with keyed surrogates in the place of personal information."""
    return pii.surrogates(*_p8(spark, folder), SECRET)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the entities, and how many surrogates as rendered are shared by two, are real entities, or differ within one entity: none."""
    return pii.surrogate_report(*_p8(spark, folder), SECRET).select("kind", "shared", "real", "split")


P8_REPORT_SQL = f"SELECT kind, CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS real, CAST(0 AS BIGINT) AS split FROM (VALUES {', '.join(f'({k!r})' for k in pii.KINDS)}) k(kind)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_distinct_seeds": p1_distinct_seeds,
        "p1_distinct_studies": p1_distinct_studies,
        "p2_percentiles": p2_percentiles,
        "p2_rank_check": p2_rank_check,
        "p2_digests": p2_digests,
        "p3_found": p3_found,
        "p3_skipping": p3_skipping,
        "p6_ids": p6_ids,
        "p6_check": p6_check,
        "p7_containers": p7_containers,
        "p7_fill": p7_fill,
        "p7_check": p7_check,
        "p8_found": p8_found,
        "p8_masked": p8_masked,
        "p8_surrogates": p8_surrogates,
        "p8_report": p8_report,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_distinct_seeds": P1_SEEDS_SQL, "p1_distinct_studies": P1_STUDIES_SQL, "p2_rank_check": P2_RANK_SQL, "p2_digests": P2_DIGESTS_SQL, "p3_found": P3_SQL, "p3_skipping": P3_SKIPPING_SQL, "p6_check": P6_CHECK_SQL, "p7_check": P7_CHECK_SQL, "p8_report": P8_REPORT_SQL}
