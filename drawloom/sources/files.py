"""Readers for the record shapes found in files, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SURVIVOR = "seed bigint, match_rate double, forward_match_rate double, reverse_match_rate double, score double, trial_number int, skip_range string, sessions string"


def tolerant_history(spark: SparkSession, path: str) -> DataFrame:
    """idx, draw of a JSON array of integers or of objects with draw, number, value or result. A draw of 0 is a draw."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    item = lambda *f: F.coalesce(*(F.get_json_object("x", f"$.{k}").cast("bigint") for k in f))
    x = text.select(F.posexplode(items).alias("idx", "x"))
    return x.select(F.col("idx").cast("bigint").alias("idx"), F.coalesce(F.col("x").try_cast("bigint"), F.when(F.col("x").startswith("{"), item("full_state", "draw", "number", "value", "result"))).alias("draw"))


def survivors(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Survivor files as a list, or wrapped in ``results`` with lists, told apart per record; later files win per seed. ``lines``: one JSON text a line."""
    inner = ",".join(p.strip().replace(" ", ":", 1) for p in SURVIVOR.split(","))
    schema = f"{SURVIVOR}, survivors array<struct<{inner}>>, results array<struct<survivors:array<struct<{inner}>>>>"
    df = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("_file", F.input_file_name())
    names = [p.split()[0] for p in SURVIVOR.replace(", ", ",").split(",")]
    flat = F.when(F.col("results").isNotNull(), F.flatten(F.transform("results", lambda r: r["survivors"]))).when(F.col("survivors").isNotNull(), F.col("survivors")).otherwise(F.array(F.struct(*names)))
    x = df.select("_file", F.explode(flat).alias("s")).select("_file", "s.*").where("seed IS NOT NULL")
    last = x.groupBy("seed").agg(F.max(F.struct("_file", *[n for n in names if n != "seed"])).alias("r"))
    return last.select("seed", *(F.col(f"r.{n}").alias(n) for n in names if n != "seed"))


def range_width(c: Column) -> Column:
    """Width of ``min-max``, or the number itself."""
    p = F.split(c.cast("string"), "-")
    return F.when(F.size(p) == 2, p[1].cast("int") - p[0].cast("int")).otherwise(p[0].try_cast("int"))


def draw_table(df: DataFrame, html: str) -> DataFrame:
    """date, session, draw of the rows of an HTML table; a wild-ball suffix is cut, and only 0..999 are draws. Exact repeats count once."""
    cell = r"<td[^>]*>\s*([^<]*?)\s*</td>"
    rows = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    x = df.select(rows.alias("r")).select(F.regexp_extract_all("r", F.lit(cell), F.lit(1)).alias("c")).where(F.size("c") >= 3)
    digits = F.regexp_replace(F.regexp_replace(F.col("c")[2], r"(?i)wild.*$", ""), r"\D", "")
    n = F.substring(digits, 1, 3).try_cast("int")
    return x.select(F.col("c")[0].alias("date"), F.lower(F.col("c")[1]).alias("session"), n.alias("draw")).where(n.between(0, 999)).distinct()


def write_results(df: DataFrame, path: str, order: str, top: int = 100) -> dict[str, str]:
    """A result as parquet, CSV and JSON lines, and its best rows; gives the paths."""
    out = {k: f"{path}/{k}" for k in ("parquet", "csv", "json", "top")}
    flat = df.select(*(F.col(c) if t not in ("array", "map", "struct") and not t.startswith(("array", "map", "struct")) else F.to_json(c).alias(c) for c, t in df.dtypes))
    df.write.parquet(out["parquet"])
    flat.write.option("header", True).csv(out["csv"])
    df.write.json(out["json"])
    df.orderBy(F.desc(order)).limit(top).write.json(out["top"])
    return out


def metadata(df: DataFrame, keys: list[str]) -> DataFrame:
    """What goes beside a written table: rows, columns, and the codes of its categories."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), *(F.array_sort(F.collect_set(k)).alias(f"codes_{k}") for k in keys))
    return n.withColumn("columns", F.lit(",".join(df.columns)))


def chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a folder of JSON lines with ``kind``: good, or error for lines that are torn or aren't JSON."""
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return d.withColumn("kind", F.when(F.col("_corrupt_record").isNull(), "good").otherwise("error")).withColumns({c: F.when(F.col("_corrupt_record").isNull(), F.col(c)) for c in d.columns[:-1]}).drop("_corrupt_record")


def write_survivors(forward: DataFrame, reverse: DataFrame, path: str, key: str = "seed") -> dict[str, str]:
    """Forward, reverse and common survivors as JSON lines, each seed once, sorted over all files; gives the paths."""
    f, r = forward.dropDuplicates([key]), reverse.dropDuplicates([key])
    out = {}
    for which, d in (("forward", f), ("reverse", r), ("bidirectional", f.join(r.select(key), key, "left_semi"))):
        out[which] = f"{path}/{which}"
        d.orderBy(key).write.json(out[which])
    return out


def export(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Every table as JSON lines in a folder of its name; gives the folders."""
    for name, d in tables.items():
        d.write.option("ignoreNullFields", False).json(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def load_survivors(spark: SparkSession, base: str) -> DataFrame:
    """Survivors of ``<base>.parquet`` if that is there, else of ``<base>.json`` in any shape, else an error."""
    there = lambda p: (h := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)
    if there(f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    if there(f"{base}.json"):
        return survivors(spark, f"{base}.json", lines=True)
    raise FileNotFoundError(base)


def write_summary(df: DataFrame, path: str, score: str, ident: str, config: dict) -> dict[str, str]:
    """A text summary of a result (rows, best) and its configuration as JSON; gives the paths."""
    out = {k: f"{path}/{k}" for k in ("summary", "config")}
    a = df.agg(F.count(F.lit(1)).cast("string").alias("rows"), F.max(F.struct(F.col(score), F.col(ident)))[ident].cast("string").alias("best"))
    a.select(F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit(""))) for c in ("rows", "best")))).alias("value")).coalesce(1).write.text(out["summary"])
    df.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True, separators=(",", ":")),)], "value string").coalesce(1).write.text(out["config"])
    return out
