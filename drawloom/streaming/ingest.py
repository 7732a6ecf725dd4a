"""Ingest of new observations as a stream of files: validation, quarantine, idempotent append, stateful counters, triggers.

Files are read once each (the file source's checkpoint), in order of arrival. Records with an id seen before are dropped; with a
watermark the ids kept as state are bounded by its delay, without one they are kept for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom.storage import scratch_path

RAW = "draw array<int>, value int, digits array<int>, draw_id string, timestamp string, draw_source string"


def read_raw(spark: SparkSession, folder: str, stream: bool = True, fmt: str = "json", schema: str = RAW, archive: str | None = None) -> DataFrame:
    """A folder of JSON, CSV or text files as a stream (or once, as a batch)."""
    r = (spark.readStream if stream else spark.read).format(fmt)
    if fmt != "text":
        r = r.schema(schema)
    if stream and archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(folder)


def parse_text(line: Column) -> Column:
    """Digits of ``1 2 3``, ``1,2,3`` or ``123``."""
    parts = F.split(F.trim(line), r"[,\s]+")
    one = F.regexp_extract_all(F.trim(line), F.lit(r"\d"), F.lit(0))
    return F.transform(F.when(F.trim(line).rlike(r"^\d{3}$"), one).otherwise(parts), lambda x: x.try_cast("int"))


def validate(df: DataFrame) -> DataFrame:
    """Normalised records with ``ok``: three digits 0..9, from any of the three input shapes."""
    v = F.col("value")
    from_value = F.when(v.between(0, 999), F.array(F.floor(v / 100) % 10, F.floor(v / 10) % 10, v % 10).cast("array<int>"))
    d = F.coalesce("draw", "digits", from_value)
    ok = F.coalesce((F.size(d) == 3) & F.forall(d, lambda x: x.between(0, 9)) & ~F.exists(d, lambda x: x.isNull()), F.lit(False))
    return df.select(
        F.col("draw_id"), d.alias("draw"), F.when(ok, d[0] * 100 + d[1] * 10 + d[2]).alias("raw_value"), F.to_timestamp("timestamp").alias("ts"), F.coalesce("draw_source", F.lit("unknown")).alias("draw_source"), ok.alias("ok")
    )


def deduplicated(df: DataFrame, ident: str = "draw_id", ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Each id once."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident]) if delay else df.dropDuplicates([ident])


def run_once(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming plan over all that is there and give what it wrote; checkpoint and result are in the shared folder.

    ``complete``: the last batch's result. ``update``: the last row of each of ``keys``. A batch that is run again writes the same place.
    """
    spark = df.sparkSession
    out, cp = scratch_path(spark, name), scratch_path(spark, f"{name}-cp")
    if mode == "append":
        q = df.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={no}" if mode == "update" else out)

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(df.schema).parquet(out)
    rest = [c for c in df.columns if c not in (keys or [])]
    got = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_no", T.LongType())])).parquet(out)
    last = got.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rest), "batch_no").alias("_r"))
    return last.select(*(keys or []), "_r.*").select(*df.columns)


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and those for the error store."""
    return df.where("ok").drop("ok"), df.where("NOT ok").drop("ok")


def miss_counter(df: DataFrame, by: str, order: str, hit: str) -> DataFrame:
    """Consecutive misses per key with state kept between batches; emits each key's count after each batch."""
    schema = f"{by} string, misses bigint, seen bigint"

    def step(key, pdfs: Iterator[pd.DataFrame], state):  # noqa: ANN001, ANN202
        misses, seen = state.get if state.exists else (0, 0)
        for pdf in pdfs:
            p = pdf.sort_values(order)
            hits = p[hit].to_numpy()
            at = hits.nonzero()[0]
            misses = len(hits) - 1 - int(at[-1]) if len(at) else misses + len(hits)
            seen += len(hits)
        state.update((misses, seen))
        yield pd.DataFrame({by: [key[0]], "misses": [misses], "seen": [seen]})

    return df.groupBy(by).applyInPandasWithState(step, schema, "misses bigint, seen bigint", "update", "NoTimeout")


#: Triggers by priority. Fixed order.
TRIGGERS = ["REGIME_SHIFT", "HIT_RATE_COLLAPSE", "CONSECUTIVE_MISSES", "CONFIDENCE_DRIFT", "N_DRAWS"]


def trigger(stability: Column, hit_rate: Column, misses: Column, drift: Column, draws: Column, cooldown: Column) -> Column:
    """The trigger of the highest priority that fires; none during a cooldown."""
    return (
        F.when(cooldown > 0, None)
        .when(stability < 0.3, TRIGGERS[0])
        .when(hit_rate < 0.05, TRIGGERS[1])
        .when(misses >= 10, TRIGGERS[2])
        .when(drift > 0.25, TRIGGERS[3])
        .when(draws >= 100, TRIGGERS[4])
    )


def flags(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items()))))


def accepted(confidence: Column, changes: Column, least: float = 0.6, most: int = 3, step: float = 0.3) -> Column:
    """Whether a proposal (an array of relative changes) may be applied without review."""
    return (confidence >= least) & (F.size(changes) <= most) & F.forall(changes, lambda x: F.abs(x) <= step)


def change_fingerprint(df: DataFrame, ident: str) -> DataFrame:
    """A fingerprint of a whole history that any change alters: order-independent, so it is a combining aggregate. An empty history is eight zeros."""
    h = F.conv(F.substring(F.md5(F.col(ident).cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.coalesce(F.substring(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")), 256), 1, 8), F.lit("0" * 8)).alias("f"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, "0" * 8).otherwise(F.col("f")).alias("fingerprint"), "n")


def append_log(df: DataFrame, name: str) -> DataFrame:
    """A stream's records appended to a log of JSON lines, exactly once per checkpoint; gives the log."""
    out, cp = scratch_path(df.sparkSession, name), scratch_path(df.sparkSession, f"{name}-cp")
    df.writeStream.format("json").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
    return df.sparkSession.read.schema(df.schema).json(out)


def synthetic(spark: SparkSession, seed: int, per_batch: int, batches: int, skip: int = 0) -> DataFrame:
    """The values of a known seed as a stream of ``batches`` batches: positions are the stream's rows, its offsets the state, and each batch jumps to its first position."""
    from drawloom.operators import generators as G

    folder, out, cp = (scratch_path(spark, n) for n in ("positions", "synthetic", "synthetic-cp"))
    for i in range(batches):
        spark.range(i * per_batch, (i + 1) * per_batch, 1, 1).write.mode("append").parquet(folder)
    src = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(folder)

    def put(batch: DataFrame, no: int) -> None:
        b = batch.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
        if b.a is not None:
            G.synthetic(batch.sparkSession, seed, b.b - b.a + 1, skip, first=b.a).write.mode("overwrite").parquet(f"{out}/batch_no={no}")

    src.writeStream.foreachBatch(put).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("idx bigint, draw bigint, batch_no bigint").parquet(out).drop("batch_no")
