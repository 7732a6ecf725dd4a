"""Parquet tables of a data folder, and the adapters that give them the shapes of the engine's domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, one file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def draws(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered integer series: idx (the time axis), draw 0..999, session, date, from the event table."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("idx"),
        (F.floor(F.col("value") * 100 + F.lit(0.5)).cast("bigint") % 1000).alias("draw"),
        F.when(F.col("event_id") % 2 == 0, "midday").otherwise("evening").alias("session"),
        F.col("ts").cast("date").alias("date"),
    )


#: The same series for the SQL oracles.
DRAWS_SQL = """draws AS (SELECT event_id AS idx, CAST(floor(value*100+0.5) AS BIGINT) % 1000 AS draw,
 CASE WHEN event_id % 2 = 0 THEN 'midday' ELSE 'evening' END AS session, CAST(ts AS DATE) AS date FROM events)"""
