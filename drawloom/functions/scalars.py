"""Scalar functions over columns: mappings of draws, squashing functions, likeness of vectors, inverses."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M32 = 0xFFFFFFFF


def draw_hash(c: Column) -> Column:
    """32 bits of a digest of the draw's text."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw_polynomial(c: Column) -> Column:
    """A polynomial of the draw modulo 2^32."""
    return (c * c * 31 + c * 17 + 7).bitwiseAND(F.lit(M32))


def draw_xor_rotate(c: Column, by: int = 7) -> Column:
    """The draw against itself rotated."""
    rot = F.shiftleft(c, by).bitwiseOR(F.shiftright(c, 32 - by)).bitwiseAND(F.lit(M32))
    return c.bitwiseXOR(rot)


def draw_multiply(c: Column) -> Column:
    """Multiplicative hashing by the golden ratio."""
    return (c * 2654435761).bitwiseAND(F.lit(M32))


MAPPINGS = {"hash": draw_hash, "polynomial": draw_polynomial, "xor_rotate": draw_xor_rotate, "multiply": draw_multiply}


def to_range(out: Column, n: int, how: str = "mod") -> Column:
    """A 32-bit output to 0..n-1, by remainder or by scale."""
    return out % n if how == "mod" else F.floor(out * n / (M32 + 1))


def sigmoid(z: Column, clamp: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z))))


def soft_norm(x: Column, scale: Column) -> Column:
    return F.tanh(x / scale)


def decay(age: Column, how: str = "exponential", half_life: float = 10.0, cut: float = 30.0) -> Column:
    """Weights of an age: exponential, linear down to the cut, or a step."""
    return {"exponential": F.exp(-age * math.log(2) / half_life), "linear": F.greatest(F.lit(0.0), 1 - age / cut), "step": F.when(age < cut, 1.0).otherwise(0.0)}[how]


def softmax(z: str, temperature: float = 0.5) -> Column:
    """Softmax of an array column."""
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a) * _dot(b, b)), F.lit(0.0))


def inverse_euclid(a: str, b: str) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    return 1 / (1 + F.sqrt(_dot(d, d)))


def pearson(a: str, b: str) -> Column:
    c = lambda v: F.transform(v, lambda x: x - F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v))
    x, y = c(a), c(b)
    return _dot(x, y) / F.nullif(F.sqrt(_dot(x, x) * _dot(y, y)), F.lit(0.0))


def clipped_z(x: Column, mean: Column, sd: Column, most: float = 3.0) -> Column:
    """Likeness 1..0 by a z-score cut at ``most``."""
    return 1 - F.least(F.lit(most), F.abs(x - mean) / F.nullif(sd, F.lit(0.0))) / most


@F.udtf(returnType=T.StructType().add("i", T.IntegerType()).add("value", T.LongType()))
class GenerateSequence:
    """Table function: the outputs of a generator, a row each."""

    def eval(self, family: str, seed: int, n: int, skip: int):  # noqa: ANN201
        import numpy as np

        from drawloom.operators.generators import sequences

        for i, v in enumerate(sequences(family, np.array([seed]), n, skip)[0]):
            yield i, int(np.int64(v.view(np.int64)))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal by Acklam's rational approximation (relative error below 1.2e-9 in theory of doubles)."""
    a = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
    b = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
    c = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)

    def poly(k: tuple, x: Column) -> Column:
        r = F.lit(k[0])
        for v in k[1:]:
            r = r * x + v
        return r

    q = p - 0.5
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + 1)
    t = lambda x: F.sqrt(-2 * F.ln(x))
    tail = lambda x: poly(c, t(x)) / (poly(d, t(x)) * t(x) + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


def inverse_erf(y: Column) -> Column:
    return inverse_normal((y + 1) / 2) / math.sqrt(2)


@F.pandas_udf(T.LongType())
def modular_inverse(a: pd.Series, m: pd.Series) -> pd.Series:
    """The inverse of a modulo m, null where there is none."""

    def one(x: int, y: int) -> int | None:
        try:
            return pow(int(x), -1, int(y))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(x, y) for x, y in zip(a, m)], dtype="Int64")


def gcd_of(df, column: str):  # noqa: ANN001, ANN201
    """The greatest common divisor of a column: per partition in NumPy, then of the partitions' few."""
    import numpy as np

    def part(it):  # noqa: ANN001, ANN202
        g = 0
        for pdf in it:
            g = int(np.gcd.reduce(np.append(pdf[column].dropna().to_numpy(dtype=np.int64), g)))
        yield pd.DataFrame({"gcd": [g]})

    p = df.select(F.col(column).cast("bigint").alias(column)).mapInPandas(part, "gcd bigint")
    return p.coalesce(1).mapInPandas(lambda it: part(x.rename(columns={"gcd": column}) for x in it), "gcd bigint")
