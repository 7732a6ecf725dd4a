"""A small declarative pipeline over scored seeds: filter, weight, mask, window, applied in that order."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 50
PROTECTED = frozenset(["score", "holdout_hits", "seed"])


def passes(field: str, operator: str, threshold: float) -> Column:
    """Null passes nothing; ``eq`` within 1e-9."""
    c = F.col(field)
    ops = {"gt": c > threshold, "gte": c >= threshold, "lt": c < threshold, "lte": c <= threshold, "eq": F.abs(c - threshold) < 1e-9}
    return F.coalesce(ops[operator], F.lit(False))


def policy_filter(df: DataFrame, field: str, operator: str, threshold: float, min_survivors: int = FLOOR, tie: str = "seed") -> DataFrame:
    """Rows that pass; where they are fewer than the floor, the floor's number of best rows by the field instead (nulls count as least)."""
    floor = max(min_survivors, FLOOR)
    ok = passes(field, operator, threshold)
    n = df.agg(F.sum(ok.cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if (n.p or 0) >= floor:
        return df.where(ok)
    if n.n < floor:
        raise ValueError(f"fewer than {floor} rows")
    order = F.col(field).desc_nulls_last() if operator in ("gt", "gte") else F.col(field).asc_nulls_first()
    return df.orderBy(order, tie).limit(floor)


def policy_weight(df: DataFrame, field: str, method: str, score: str = "score", alpha: float = 1.0, threshold: float = 0.5, boost: float = 2.0) -> DataFrame:
    """The score times a weight of the field, min-max normalised (one half where all are equal): linear, exponential or step."""
    b = df.agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"))
    x = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.coalesce(F.col(field), F.col("_lo")) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    w = {"linear": 1 + alpha * x, "exponential": F.exp(alpha * x), "step": F.when(x >= threshold, F.lit(boost)).otherwise(1.0)}[method]
    return df.crossJoin(F.broadcast(b)).withColumn(score, F.col(score) * w).drop("_lo", "_hi")


def policy_mask(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops features; protected columns can't be masked."""
    if PROTECTED & set(names):
        raise ValueError("a protected column can't be masked")
    return df.drop(*names)


def policy_window(df: DataFrame, start: int, end: int | None, order: str = "seed") -> DataFrame:
    """Rows by position in the order, from start to end (exclusive); no end, or 0, means all that follow."""
    from drawloom.operators.windows import row_index

    x = row_index(df, "_pos", order).where(F.col("_pos") >= max(0, start))
    return (x.where(F.col("_pos") < end) if end else x).drop("_pos")


def apply(df: DataFrame, policy: dict) -> DataFrame:
    """All transforms of a policy; an empty policy changes nothing."""
    t = policy.get("transforms", {})
    if t.get("filter"):
        df = policy_filter(df, **t["filter"])
    if t.get("weight"):
        df = policy_weight(df, **t["weight"])
    if t.get("mask"):
        df = policy_mask(df, t["mask"])
    if t.get("window"):
        df = policy_window(df, t["window"].get("start", 0), t["window"].get("end"))
    return df


def fingerprint(policy: dict) -> str:
    """16 hex digits over the sorted policy."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()[:16]
