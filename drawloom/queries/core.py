"""Queries of the core operators for pipelines over references and drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions.keys import key, key_sql
from drawloom.operators import references, schema_drift
from drawloom.sources.tables import table
from drawloom.storage import written


_FIELDS = {"attempts.fingerprint": ("fingerprint", "fingerprint_summary", "first_seen"), "attempts.run_id": ("run_id", "runs", "started_at")}


def _p4(spark: SparkSession, folder: str) -> tuple[references.Judged, DataFrame]:
    """The references of attempts, both fields in one pass, judged; and the summaries that no attempt is of."""
    rows = table(spark, folder, "attempts").select("id", key("fingerprint").alias("fingerprint"), key("run_id").alias("run_id"), "attempted_at").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(c).alias("key")) for f, (c, _, _) in _FIELDS.items())))
    refs = rows.select(F.col("id").cast("string").alias("ref_id"), F.col("attempted_at").alias("at"), F.date_format("attempted_at", "yyyy-MM").alias("period"), each.alias("f"))
    recs = [table(spark, folder, t).select(F.lit(f).alias("ref_field"), key(c).alias("key"), F.col(start).alias("start"), F.col("deleted_at").alias("end")) for f, (c, t, start) in _FIELDS.items()]
    # distinct attempts that repeat an id with other times or keys may still give one reference twice
    j = references.judge(refs.select("ref_id", "at", "period", "f.*"), recs[0].unionByName(recs[1]), ["ref_field"])
    alone = references.never_referred(recs[0], j.cells.where("ref_field = 'attempts.fingerprint'"))
    alone = alone.select(F.lit("fingerprint_summary.fingerprint").alias("ref_field"), F.col("key").alias("row_key"), F.date_format("start", "yyyy-MM").alias("month_key"), F.lit("missing").alias("why")).distinct()
    return j, alone


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per orphan reference."""
    j, alone = _p4(spark, folder)
    return j.rows().select("ref_field", F.col("ref_id").alias("row_key"), F.col("period").alias("month_key"), "why").unionByName(alone)


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per reference, month and kind."""
    j, alone = _p4(spark, folder)
    own = j.counts().select("ref_field", F.col("period").alias("month_key"), "why", F.col("n").alias("n_refs"))
    return own.unionByName(alone.groupBy("ref_field", "month_key", "why").agg(F.count(F.lit(1)).alias("n_refs")))


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    """Per reference: the heavy keys that are joined apart, their references, and the orphans among these and among all others."""
    j, _ = _p4(spark, folder)
    rows = j.rows().groupBy("ref_field", "key").agg(F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast((j.heavy if j.heavy is not None else j.cells.limit(0)).select("ref_field", "key", F.col("n").alias("_n")))
    hot = lambda c: F.coalesce(F.sum(F.when(F.col("_n").isNotNull(), F.col(c))), F.lit(0))
    o = rows.join(heavy, ["ref_field", "key"], "left").groupBy("ref_field").agg(hot("n").alias("heavy_orphans"), F.coalesce(F.sum(F.when(F.col("_n").isNull(), F.col("n"))), F.lit(0)).alias("other_orphans"))
    k = j.cells.groupBy("ref_field", "key").agg(F.sum("n").alias("n")).join(heavy, ["ref_field", "key"], "left").groupBy("ref_field").agg(F.count("_n").alias("heavy_keys"), hot("n").alias("heavy_refs"), F.sum("n").alias("refs"))
    return k.join(o, "ref_field", "left").select("ref_field", "heavy_keys", "heavy_refs", "refs", "heavy_orphans", "other_orphans")


_P4_SPLIT_SQL = f"""WITH a AS (SELECT DISTINCT id, attempted_at, f.ref_field, f.key FROM attempts, LATERAL (VALUES ('attempts.fingerprint', {key_sql('fingerprint')}), ('attempts.run_id', {key_sql('run_id')})) f(ref_field, key) WHERE f.key IS NOT NULL),
k AS (SELECT ref_field, key, count(*) AS n FROM a GROUP BY ALL), h AS (SELECT * FROM k WHERE n >= {references.HEAVY_TIMES} * (SELECT avg(n) FROM k) ORDER BY n DESC, ref_field, key LIMIT {references.HEAVY_KEYS}),
o AS (SELECT f.ref_field, CASE f.ref_field WHEN 'attempts.run_id' THEN {key_sql('a.run_id')} ELSE {key_sql('a.fingerprint')} END AS key FROM (@FOUND@) f JOIN (SELECT DISTINCT id, fingerprint, run_id FROM attempts) a ON f.row_key = CAST(a.id AS VARCHAR) WHERE f.ref_field LIKE 'attempts.%'),
c AS (SELECT o.ref_field, count(h.key) AS hot, count(*) - count(h.key) AS cold FROM o LEFT JOIN h USING (ref_field, key) GROUP BY o.ref_field)
SELECT k.ref_field, count(h.key) AS heavy_keys, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS heavy_refs, CAST(sum(k.n) AS BIGINT) AS refs, any_value(c.hot) AS heavy_orphans, any_value(c.cold) AS other_orphans FROM k LEFT JOIN h USING (ref_field, key) LEFT JOIN c USING (ref_field) GROUP BY k.ref_field"""


def _p4_sql() -> str:
    part = lambda field, tab, start: f"""SELECT 'attempts.{field}' AS ref_field, CAST(a.id AS VARCHAR) AS row_key, strftime(a.attempted_at, '%Y-%m') AS month_key,
 CASE WHEN count(r.k) = 0 THEN 'missing' WHEN bool_and(r.s > a.attempted_at) THEN 'late' ELSE 'deleted' END AS why
 FROM (SELECT DISTINCT id, {key_sql(field)} AS k, attempted_at FROM attempts) a LEFT JOIN (SELECT {key_sql(field)} AS k, {start} AS s, deleted_at AS e FROM {tab}) r ON a.k = r.k
 WHERE a.k IS NOT NULL GROUP BY a.id, a.attempted_at, a.k HAVING NOT coalesce(bool_or(r.s <= a.attempted_at AND (r.e IS NULL OR r.e > a.attempted_at)), FALSE)"""  # noqa: E731
    return f"""{part('fingerprint', 'fingerprint_summary', 'first_seen')} UNION ALL {part('run_id', 'runs', 'started_at')}
 UNION ALL SELECT DISTINCT 'fingerprint_summary.fingerprint', {key_sql('fingerprint')}, strftime(first_seen, '%Y-%m'), 'missing' FROM fingerprint_summary
 WHERE {key_sql('fingerprint')} IS NOT NULL AND {key_sql('fingerprint')} NOT IN (SELECT {key_sql('fingerprint')} FROM attempts WHERE {key_sql('fingerprint')} IS NOT NULL)"""


_DRIFTING = ["watcher_training_incidents", "feature_registry"]


def _fields(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        d = schema_drift.file_fields(table(spark, folder, n), n)
        out = d if out is None else out.unionByName(d)
    return written(out, "fields")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change between a writer's file and the one before it."""
    return schema_drift.changes(_fields(spark, folder, _DRIFTING))


def p5_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that came, went or changed their types between a writer's neighbouring files, before renames are told."""
    return schema_drift.differences(_fields(spark, folder, _DRIFTING))


P5_DIFFERENCES_SQL = """WITH raw AS (SELECT 'watcher_training_incidents' AS src_table, writer_id, file_no, raw FROM watcher_training_incidents UNION ALL SELECT 'feature_registry', writer_id, file_no, raw FROM feature_registry),
ok AS (SELECT DISTINCT src_table, writer_id, file_no, raw FROM raw WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE FALSE END),
chain AS (SELECT *, lag(file_no) OVER (PARTITION BY src_table, writer_id ORDER BY file_no) AS prev FROM (SELECT DISTINCT src_table, writer_id, file_no FROM ok)),
leaf AS (SELECT DISTINCT src_table, writer_id, file_no, replace(substr(j.fullkey, 3), '"', '') AS path, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS t FROM ok, json_tree(ok.raw) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[')),
f AS (SELECT src_table, writer_id, file_no, path, string_agg(t, '|' ORDER BY t) AS types FROM leaf GROUP BY ALL),
d AS (SELECT c.src_table, c.writer_id, c.file_no, f.path, f.types AS now, NULL AS was FROM chain c JOIN f USING (src_table, writer_id, file_no) WHERE c.prev IS NOT NULL
 UNION ALL SELECT c.src_table, c.writer_id, c.file_no, f.path, NULL, f.types FROM chain c JOIN f ON f.src_table = c.src_table AND f.writer_id = c.writer_id AND f.file_no = c.prev),
m AS (SELECT src_table, writer_id, file_no, path, max(now) AS now, max(was) AS was FROM d GROUP BY ALL)
SELECT src_table, writer_id, file_no, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'retyped' END AS change_kind, path AS field_path, coalesce(was, '') AS old_value, coalesce(now, '') AS new_value FROM m WHERE was IS DISTINCT FROM now"""


def p5_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of ``p5_found`` with each rename taken apart into what went and what came: the same as ``p5_differences``."""
    c = p5_found(spark, folder)
    base = [F.col(x) for x in ("src_table", "writer_id", "file_no")]
    ren = c.where("change_kind = 'renamed'")
    went = ren.select(*base, F.lit("removed").alias("change_kind"), "field_path", "old_value", F.lit("").alias("new_value"))
    came = ren.select(*base, F.lit("added").alias("change_kind"), F.col("new_value").alias("field_path"), F.lit("").alias("old_value"), F.col("old_value").alias("new_value"))
    return c.where("change_kind <> 'renamed'").unionByName(went).unionByName(came)


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of both consistent tables per writer."""
    out = None
    for n in _DRIFTING:
        d = _p5_records(spark, folder, n).groupBy("writer_id").agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(n).alias("src_table"), "writer_id", "n_records")
        out = d if out is None else out.unionByName(d)
    return out


P5_RECORDS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS src_table, writer_id, count(*) AS n_records FROM (SELECT DISTINCT writer_id, file_no, line_no, raw FROM {n}) WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE FALSE END GROUP BY writer_id" for n in _DRIFTING)


def _p5_records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    f = _fields(spark, folder, [name])
    rows = table(spark, folder, name).dropDuplicates(["writer_id", "file_no", "line_no", "raw"])
    return schema_drift.consistent(rows, f, schema_drift.changes(f), ["writer_id", "file_no", "line_no"])


def p5_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """All incident records in one consistent table."""
    return _p5_records(spark, folder, "watcher_training_incidents")


def p5_registry(spark: SparkSession, folder: str) -> DataFrame:
    """All feature registries in one consistent table."""
    return _p5_records(spark, folder, "feature_registry")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_counts": p4_counts, "p4_split": p4_split, "p5_found": p5_found, "p5_differences": p5_differences, "p5_unresolved": p5_unresolved, "p5_records": p5_records, "p5_incidents": p5_incidents, "p5_registry": p5_registry}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _p4_sql(), "p5_differences": P5_DIFFERENCES_SQL, "p5_unresolved": P5_DIFFERENCES_SQL, "p5_records": P5_RECORDS_SQL, "p4_split": _P4_SPLIT_SQL.replace("@FOUND@", _p4_sql()), "p4_counts": f"SELECT ref_field, month_key, why, count(*) AS n_refs FROM ({_p4_sql()}) GROUP BY ALL"}
