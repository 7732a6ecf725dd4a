"""Statistics as aggregate columns and small plans, with closed forms where a library would be needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy_bits(n: str = "n", by: list[str] | None = None, df: DataFrame | None = None) -> DataFrame:
    """Shannon entropy in bits of counts, per group: log2(N) - sum(n log2 n) / N, in one aggregate."""
    x = F.col(n).cast("double")
    h = F.log2(F.sum(x)) - F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)) / F.sum(x)
    return df.groupBy(*(by or [])).agg(h.alias("entropy"))


def entropy_smoothed(counts: DataFrame, states: int, by: list[str] | None = None, n: str = "n", eps: float = 1e-10) -> DataFrame:
    """Entropy in nats over ``states`` classes, each share raised by eps and renormalised, divided by ln(states). Absent classes count in closed form."""
    x = F.col(n).cast("double")
    tot = F.sum(x).alias("_t")
    g = counts.groupBy(*(by or [])).agg(tot, F.collect_list(x).alias("_c"))
    z = 1 + states * eps
    part = F.aggregate("_c", F.lit(0.0), lambda a, c: a - ((c / F.col("_t") + eps) / z) * F.ln((c / F.col("_t") + eps) / z))
    rest = (states - F.size("_c")) * (-(eps / z) * math.log(eps / z))
    return g.select(*(by or []), ((part + rest) / math.log(states)).alias("entropy"))


def chi_square(counts: DataFrame, states: int, by: list[str] | None = None, n: str = "n") -> DataFrame:
    """Chi-square against equal shares over ``states`` classes, and its p-value by the Wilson-Hilferty approximation. Absent classes count."""
    x = F.col(n).cast("double")
    g = counts.groupBy(*(by or [])).agg(F.sum(x).alias("total"), F.sum(x * x).alias("_sq"))
    chi = states * F.col("_sq") / F.col("total") - F.col("total")
    return g.select(*(by or []), F.col("total").cast("bigint").alias("total"), chi.alias("chi2"), chi_p(chi, F.lit(states - 1.0)).alias("p_value"))


def chi_p(chi: Column, dof: Column) -> Column:
    """Upper tail of chi-square by Wilson and Hilferty's cube root."""
    z = (F.pow(chi / dof, 1 / 3) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    return 1 - normal_cdf(z)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


NORMAL_CDF_SQL = """CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END"""


def normal_cdf_sql(z: str) -> str:
    """The same for DuckDB."""
    k = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"
    tail = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def kl(p: Column, q: Column) -> Column:
    """One term of the divergence of p from q."""
    return F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)


def divergences(counts: DataFrame, a: str, b: str, m: int, eps: float = 1e-10) -> DataFrame:
    """One row: the divergence of counts ``a`` from counts ``b``, one row per value of the whole domain of m values, in four forms: shares
    clamped and renormalised, clamped only, counts with one added, shares with a small number added."""
    x = counts.crossJoin(F.broadcast(counts.agg(F.sum(a).alias("_sa"), F.sum(b).alias("_sb"))))
    p, q = F.col(a) / F.col("_sa"), F.col(b) / F.col("_sb")
    x = x.select(F.greatest(p, F.lit(eps)).alias("p"), F.greatest(q, F.lit(eps)).alias("q"), ((F.col(a) + 1) / (F.col("_sa") + m)).alias("p1"), ((F.col(b) + 1) / (F.col("_sb") + m)).alias("q1"), (p + eps).alias("pe"), (q + eps).alias("qe"))
    term = lambda u, v: F.col(u) * F.ln(F.col(u) / F.col(v))
    g = x.agg(F.sum(term("p", "q")).alias("clamped"), F.sum(term("p1", "q1")).alias("add_one"), F.sum(term("pe", "qe")).alias("epsilon"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    # with shares p / P and q / Q: sum of p / P ln(p Q / (q P))
    return g.select((F.col("clamped") / F.col("_p") + F.ln(F.col("_q") / F.col("_p"))).alias("renormalised"), "clamped", "add_one", "epsilon")
