"""Ordered operations over one very long series without a window that holds all of it.

A series has a dense integer order ``idx`` (materialised at the scan). Rows are dealt to blocks of ``BLOCK`` positions. Lags and
leads come from a window per block, whose last rows are lent to the next block (a halo); running sums and row numbers come from a
window per block plus the sum of the blocks before, a window over one row per block. Each takes one shuffle on the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _keys(by: list[str] | None) -> list[str]:
    return list(by or [])


def lagged(df: DataFrame, value: str | list[str], lags: list[int], order: str = "idx", block: int = BLOCK, prefix: str | None = None) -> DataFrame:
    """Adds ``<value>_lag<L>`` for each lag: the value at order - L, null where there is none. Order must be dense within the series."""
    values = [value] if isinstance(value, str) else value
    most = max(lags)
    b = F.floor(F.col(order) / block).cast("bigint")
    spill = F.floor((F.col(order) + most) / block).cast("bigint")
    x = df.withColumn("_b", F.explode(F.sequence(b, spill))).withColumn("_own", F.col("_b") == b)
    w = Window.partitionBy("_b").orderBy(order)
    for v in values:
        for n in lags:
            x = x.withColumn(f"{prefix or v}_lag{n}", F.lag(v, n).over(w))
    return x.where("_own").drop("_b", "_own")


def running_sum(df: DataFrame, value: Column, name: str, order: str = "idx", block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with this one."""
    x = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block).cast("bigint"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum("_v").over(w))
    tot = x.groupBy("_b").agg(F.sum("_v").alias("_t"))
    v = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    off = tot.select("_b", F.coalesce(F.sum("_t").over(v), F.lit(0)).alias("_off"))
    return x.join(off, "_b").withColumn(name, F.col("_in") + F.col("_off")).drop("_b", "_v", "_in", "_off")


def row_index(df: DataFrame, name: str = "pos", order: str = "idx", block: int = BLOCK) -> DataFrame:
    """Adds the 0-based position in the order, which need not be dense here."""
    return running_sum(df, F.lit(1).cast("bigint"), name, order, block).withColumn(name, F.col(name) - 1)


def window_scan(df: DataFrame, size: int, offset: int = 0, sessions: list[str] | None = None, order: str = "idx") -> DataFrame:
    """Sessions are filtered first, then ``size`` rows from ``offset`` (clamped to the series) are cut out; adds ``pos`` within the cut.

    A series shorter than ``size`` gives no rows.
    """
    if sessions:
        df = df.where(F.col("session").isin(sessions))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    x = row_index(df, "pos", order).crossJoin(F.broadcast(n))  # one row
    start = F.greatest(F.lit(0), F.least(F.lit(offset), F.col("_n") - size))
    return x.where((F.col("_n") >= size) & (F.col("pos") >= start) & (F.col("pos") < start + size)).withColumn("pos", (F.col("pos") - start).cast("int")).drop("_n")


def sliding(df: DataFrame, size: int, stride: int, n: int | None = None, order: str = "idx", start: int = 0) -> DataFrame:
    """Each row once per full window that holds it (column ``win``, 0-based): windows begin at 0, stride, 2 stride..., and end within the series."""
    last = F.lit(n) if n is not None else F.col("_n")
    if n is None:
        df = df.crossJoin(F.broadcast(df.agg((F.max(order) - start + 1).alias("_n"))))
    i = F.col(order) - start
    lo = F.greatest(F.lit(0), F.ceil((i - size + 1) / stride))
    hi = F.least(F.floor(i / stride), F.floor((last - size) / stride))
    x = df.where(lo <= hi).withColumn("win", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    return x.drop("_n") if n is None else x


def islands(df: DataFrame, value: str, order: str = "idx", block: int = BLOCK) -> DataFrame:
    """Maximal runs of equal values: island, value, first, last, length."""
    x = lagged(df, value, [1], order, block)
    prev = F.col(f"{value}_lag1")
    new = F.when(prev.isNull() | (prev != F.col(value)), 1).otherwise(0)
    x = running_sum(x.drop(), new, "island", order, block)
    return x.groupBy("island").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def streaks(df: DataFrame, value: str, least: int = 2, order: str = "idx") -> DataFrame:
    """Runs of at least ``least`` equal values; the run at the very end of the series is still open and not given."""
    i = islands(df, value, order)
    end = df.agg(F.max(order).alias("_end"))
    return i.crossJoin(F.broadcast(end)).where((F.col("length") >= least) & (F.col("last") < F.col("_end"))).drop("_end")


def gaps(df: DataFrame, value: str, order: str = "idx") -> DataFrame:
    """Distance to the previous row of the same value; a hot value is one window of the sort-based kind, which spills."""
    w = Window.partitionBy(value).orderBy(order)
    return df.withColumn("gap", F.col(order) - F.lag(order).over(w))


def transitions(df: DataFrame, value: Column, lag: int = 1, order: str = "idx", smooth: float = 0.0, states: int | None = None) -> DataFrame:
    """prev, next, n and the share p of next after prev; with ``smooth`` over all of ``states``."""
    x = lagged(df.withColumn("_s", value), "_s", [lag], order, prefix="_p")
    c = x.where(f"_p_lag{lag} IS NOT NULL").groupBy(F.col(f"_p_lag{lag}").alias("prev"), F.col("_s").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    if smooth and states:
        spark = df.sparkSession
        s = spark.range(states)
        grid = s.select(F.col("id").alias("prev")).crossJoin(F.broadcast(s.select(F.col("id").alias("next"))))  # states squared, a parameter
        c = grid.join(c, ["prev", "next"], "left").select("prev", "next", F.coalesce("n", F.lit(0)).alias("n"))
    t = F.sum("n").over(Window.partitionBy("prev"))
    k = F.lit(smooth)
    return c.withColumn("p", (F.col("n") + k) / (t + k * (states or 0)))
