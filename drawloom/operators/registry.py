"""Stores of results, trials and attempts: lookups, upserts, queues and reports, as plain relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of the same keys (the last by ``order`` among equals within ``new``); others are kept."""
    cols = [c for c in store.columns if c not in keys]
    tag = lambda d, n, rank: d.select(*keys, F.struct(F.lit(n).alias("_n"), rank.alias("_o"), F.struct(*cols).alias("_r")).alias("_v"))
    late = tag(new, 1, F.struct(*(order or [F.lit(0)]))).groupBy(*keys).agg(F.max("_v").alias("_v")).select(*keys, F.col("_v._r").alias("_r"))
    kept = store.join(late.select(*keys), keys, "left_anti").select(*keys, F.struct(*cols).alias("_r"))
    return kept.unionByName(late).select(*keys, "_r.*").select(*store.columns)


def insert_absent(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys the store has not are added, each key once."""
    return store.unionByName(new.select(*store.columns).dropDuplicates(keys).join(store.select(*keys), keys, "left_anti").select(*store.columns))


def expire(df: DataFrame, at: str, ttl_days: int, now: Column) -> DataFrame:
    """Rows not older than the time to live."""
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL {ttl_days} DAYS"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and share of the total in percent, one digit."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("_t"))
    return c.crossJoin(F.broadcast(t)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("_t"), 1).alias("percent"))


def watermark(df: DataFrame, by: str, end: str, all_keys: DataFrame) -> DataFrame:
    """The next start per key: the greatest end so far, 0 for keys without any."""
    m = df.groupBy(by).agg(F.max(end).alias("_e"))
    return all_keys.join(m, by, "left").select(by, F.coalesce("_e", F.lit(0)).alias("next_start"))


def job_queue(df: DataFrame, n: int, kinds: list[str] | None = None, least: int | None = None) -> DataFrame:
    """Pending jobs by priority, then age; predicates only where given."""
    d = df.where("status = 'pending'")
    if kinds:
        d = d.where(F.col("kind").isin(kinds))
    if least is not None:
        d = d.where(F.col("priority") >= least)
    return d.orderBy(F.desc("priority"), "created_at", "job_id").limit(n)
