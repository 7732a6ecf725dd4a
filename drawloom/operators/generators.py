"""Pseudo-random sequence generators: vectorised steppers over many seeds, and affine jump-ahead for congruential families.

A stepper keeps the state of a whole batch of seeds in NumPy arrays (uint64 wraps, as these generators want) and advances all at
once. Congruential families also have a closed form, state after p steps = A_p * seed + C_p, with A and C worked out once on the
driver, so that a sieve over them is a stateless column expression. New families are registered with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
M32 = U64(0xFFFFFFFF)


class Stepper:
    """State of a batch of seeds; ``step`` advances all and gives the outputs as uint64."""

    def __init__(self, seeds: np.ndarray):
        self.start(np.asarray(seeds).astype(np.int64).view(U64))

    def start(self, s: np.ndarray) -> None:
        raise NotImplementedError

    def step(self) -> np.ndarray:
        raise NotImplementedError

    def keep(self) -> tuple:
        """A copy of the state."""
        return tuple(v.copy() if isinstance(v, np.ndarray) else v for v in self.__dict__.values())

    def back(self, kept: tuple, where: np.ndarray | None = None) -> None:
        """Restore a copy, for all seeds or those of a mask."""
        for k, v in zip(list(self.__dict__), kept):
            now = self.__dict__[k]
            if where is None or not isinstance(v, np.ndarray):
                self.__dict__[k] = v.copy() if isinstance(v, np.ndarray) else v
            else:
                self.__dict__[k] = np.where(where if v.ndim == 1 else where[:, None], v, now)


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


class Xorshift32(Stepper):
    def start(self, s):
        self.x = s & M32

    def step(self):
        x = self.x
        x = x ^ ((x << U64(13)) & M32)
        x = x ^ (x >> U64(17))
        self.x = x ^ ((x << U64(5)) & M32)
        return self.x


class Xorshift128(Stepper):
    def start(self, s):
        full = lambda v: np.full(len(s), v, U64)
        self.x, self.y, self.z, self.w = s & M32, full(362436069), full(521288629), full(88675123)

    def step(self):
        t = self.x ^ ((self.x << U64(11)) & M32)
        w = self.w ^ (self.w >> U64(19)) ^ t ^ (t >> U64(8))
        self.x, self.y, self.z, self.w = self.y, self.z, self.w, w & M32
        return self.w


class Xorshift64Star(Stepper):
    """The product is fed back as the state; the output is its low half."""

    def start(self, s):
        self.x = s

    def step(self):
        x = self.x
        x = x ^ (x >> U64(12))
        x = x ^ (x << U64(25))
        x = x ^ (x >> U64(27))
        self.x = x * U64(0x2545F4914F6CDD1D)
        return self.x & M32


class Xorshift64Wide(Xorshift64Star):
    """The whole state as the output: what sieves compare."""

    def step(self):
        super().step()
        return self.x


class Congruential(Stepper):
    """A 31 to 48 bit linear congruential generator, in limbs where products pass 64 bits."""

    a, c, m, shift, mask = 1, 0, 1 << 48, 0, None

    def start(self, s):
        self.x = s & U64(self.m - 1) if self.mask else s % U64(self.m)

    def step(self):
        x = self.x * U64(self.a) + U64(self.c)  # wraps at 2^64, which keeps the low 48 bits
        self.x = x & U64(self.m - 1) if self.mask else x % U64(self.m)
        return (self.x >> U64(self.shift)) & M32


class JavaLcg(Congruential):
    a, c, m, shift, mask = 25214903917, 11, 1 << 48, 16, True


class Lcg32(Congruential):
    a, c, m, shift, mask = 1103515245, 12345, 0x7FFFFFFF, 0, False

    def start(self, s):
        self.x = s & M32


class Lcg32Masked(Lcg32):
    """The modulus taken as a mask, as the hybrid sieve has it."""

    def step(self):
        self.x = (self.x * U64(self.a) + U64(self.c)) & U64(self.m)
        return self.x


class Minstd(Congruential):
    a, c, m, shift, mask = 48271, 0, 2147483647, 0, False

    def start(self, s):
        x = s % U64(self.m)
        self.x = np.where(x == 0, U64(1), x)


class Pcg32(Stepper):
    a, c = U64(6364136223846793005), U64(1442695040888963407 | 1)

    def start(self, s):
        self.x = s

    def step(self):
        o = self.x
        self.x = o * self.a + self.c
        v = (((o >> U64(18)) ^ o) >> U64(27)) & M32
        r = (o >> U64(59)) & U64(31)
        return ((v >> r) | (v << ((U64(32) - r) & U64(31)))) & M32


class Pcg32Ahead(Pcg32):
    """Outputs of the state after the step, as the hybrid sieve has it."""

    def step(self):
        self.x = self.x * self.a + self.c
        o = self.x
        v = (((o >> U64(18)) ^ o) >> U64(27)) & M32
        r = (o >> U64(59)) & U64(31)
        return ((v >> r) | (v << ((U64(32) - r) & U64(31)))) & M32


class Xoshiro256pp(Stepper):
    def start(self, s):
        full = lambda v: np.full(len(s), v, U64)
        self.a, self.b, self.c, self.d = s.copy(), full(0x9E3779B97F4A7C15), full(0x6A09E667F3BCC908), full(0xBB67AE8584CAA73B)

    def step(self):
        out = _rotl(self.a + self.d, 23) + self.a
        t = self.b << U64(17)
        c = self.c ^ self.a
        d = self.d ^ self.b
        self.b, self.a = self.b ^ c, self.a ^ d
        self.c, self.d = c ^ t, _rotl(d, 45)
        return out


class Sfc64(Stepper):
    def start(self, s):
        full = lambda v: np.full(len(s), v, U64)
        self.a, self.b, self.c, self.n = s.copy(), full(0x9E3779B97F4A7C15), full(0x6A09E667F3BCC908), full(1)

    def step(self):
        out = self.a + self.b + self.n
        self.n = self.n + U64(1)
        self.a = self.b ^ (self.b >> U64(11))
        self.b = self.c + (self.c << U64(3))
        self.c = _rotl(self.c, 24) + out
        return out


class Philox4x32(Stepper):
    """Ten rounds on a counter; word 0 of each block."""

    def start(self, s):
        self.k0, self.k1, self.n = s & M32, s >> U64(32), np.zeros(len(s), U64)

    def step(self):
        k0, k1 = self.k0, self.k1
        a, b, c, d = self.n & M32, *(np.zeros(len(k0), U64) for _ in range(3))
        for _ in range(10):
            p, q = a * U64(0xD2511F53), c * U64(0xCD9E8D57)
            a, b, c, d = (q >> U64(32)) ^ b ^ k0, q & M32, (p >> U64(32)) ^ d ^ k1, p & M32
            k0, k1 = (k0 + U64(0x9E3779B9)) & M32, (k1 + U64(0xBB67AE85)) & M32
        self.n = self.n + U64(1)
        return a


class Mt19937(Stepper):
    """The 1998 generator with its 2002 initialisation; 624 words a seed, so batches are kept small."""

    def start(self, s):
        st = np.empty((len(s), 624), U64)
        st[:, 0] = s & M32
        for i in range(1, 624):
            st[:, i] = (U64(1812433253) * (st[:, i - 1] ^ (st[:, i - 1] >> U64(30))) + U64(i)) & M32
        # each seed has its own place, as sieves with varying skips bring seeds apart
        self.st, self.at = st, np.full(len(s), 624)

    def step(self):
        used = self.at == 624
        if used.any():
            st = self.st if used.all() else self.st[used]
            for i in range(624):
                y = (st[:, i] & U64(0x80000000)) | (st[:, (i + 1) % 624] & U64(0x7FFFFFFF))
                st[:, i] = st[:, (i + 397) % 624] ^ (y >> U64(1)) ^ ((y & U64(1)) * U64(0x9908B0DF))
            self.st[used], self.at[used] = st, 0
        y = self.st[np.arange(len(self.at)), self.at]
        self.at = self.at + 1
        y ^= y >> U64(11)
        y ^= (y << U64(7)) & U64(0x9D2C5680)
        y ^= (y << U64(15)) & U64(0xEFC60000)
        return y ^ (y >> U64(18))


@dataclass(frozen=True)
class Family:
    name: str
    stepper: type[Stepper]
    seed_bits: int = 32
    #: (a, c, m, shift): state after p steps is affine in the seed
    affine: tuple[int, int, int, int] | None = None
    batch: int = 50_000
    #: what sieves compare, and what the hybrid sieve does, where these differ from the generator's own outputs
    sieved: type[Stepper] | None = None
    hybrid: type[Stepper] | None = None
    #: the state after a value that no skip matches, see ``sieve.hybrid``
    on_miss: str = "drift"
    #: for subclasses and notes
    extra: dict = field(default_factory=dict)

    def for_sieve(self) -> type[Stepper]:
        return self.sieved or self.stepper

    def for_hybrid(self) -> type[Stepper]:
        return self.hybrid or self.for_sieve()


FAMILIES: dict[str, Family] = {}


def register(f: Family) -> None:
    """Add a family, or replace one."""
    FAMILIES[f.name] = f


for _f in (
    Family("xorshift32", Xorshift32),
    Family("java_lcg", JavaLcg, 48, (25214903917, 11, 1 << 48, 16)),
    Family("minstd", Minstd, 32, (48271, 0, 2147483647, 0)),
    Family("xorshift128", Xorshift128),
    Family("xorshift64", Xorshift64Star, 64, sieved=Xorshift64Wide),
    Family("pcg32", Pcg32, 64, hybrid=Pcg32Ahead, on_miss="stay"),
    Family("lcg32", Lcg32, 32, (1103515245, 12345, 0x7FFFFFFF, 0), hybrid=Lcg32Masked),
    Family("xoshiro256pp", Xoshiro256pp, 64, on_miss="step"),
    Family("philox4x32", Philox4x32, 64, on_miss="step"),
    Family("sfc64", Sfc64, 64, on_miss="step"),
    Family("mt19937", Mt19937, 32, None, 4_000, on_miss="over"),
):
    register(_f)


def catalogue(spark: SparkSession) -> DataFrame:
    """The registry as a table: each family in its plain, hybrid, reverse and hybrid-reverse kind."""
    rows = [(f.name + k, f.name, f.seed_bits, bool(f.affine), "reverse" in k, "hybrid" in k) for f in FAMILIES.values() for k in ("", "_hybrid", "_reverse", "_hybrid_reverse")]
    return spark.createDataFrame(rows, "generator string, family string, seed_bits int, affine boolean, reverse boolean, hybrid boolean")


def sequences(family: str, seeds: np.ndarray, n: int, skip: int = 0, every: bool = False) -> np.ndarray:
    """(seeds, n) outputs. ``skip`` outputs are burnt once at the start, or with ``every`` before each output as well."""
    g = FAMILIES[family].stepper(seeds)
    for _ in range(skip):
        g.step()
    out = np.empty((len(seeds), n), U64)
    for i in range(n):
        if every and i:
            for _ in range(skip):
                g.step()
        out[:, i] = g.step()
    return out


def with_sequence(df: DataFrame, family: str, seed: str, n: int, skip: int = 0, every: bool = False, name: str = "outputs", mod: int | None = None) -> DataFrame:
    """Adds an array of the first n outputs per seed, in Arrow batches."""
    batch = FAMILIES[family].batch

    @F.pandas_udf("array<bigint>")
    def gen(s: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(s), batch):
            x = sequences(family, s.iloc[i : i + batch].to_numpy(), n, skip, every)
            out += list((x % U64(mod) if mod else x).view(np.int64))
        return pd.Series(out)

    return df.withColumn(name, gen(F.col(seed)))


def synthetic(spark: SparkSession, seed: int, n: int, skip: int = 0, family: str = "java_lcg", mod: int = 1000, first: int = 0, parts: int | None = None) -> DataFrame:
    """idx, draw of n values of a known seed from the position ``first``, skip + 1 steps each. Each task jumps to its first position, so that any length is made in parallel. Affine families only."""
    f, step = FAMILIES[family], skip + 1

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            idx = pdf["idx"].to_numpy()
            x = jump(f.affine, (int(idx[0]) + 1) * step) if len(idx) else (1, 0)
            a, c = jump(f.affine, step)
            m, shift = f.affine[2:]
            v, out = (x[0] * reduced(f, seed) + x[1]) % m, []
            for _ in idx:
                out.append(((v >> shift) & 0xFFFFFFFF) % mod)
                v = (a * v + c) % m
            yield pd.DataFrame({"idx": idx, "draw": np.array(out, np.int64)})

    r = spark.range(first, first + n, 1, parts) if parts else spark.range(first, first + n)
    return r.withColumnRenamed("id", "idx").mapInPandas(run, "idx bigint, draw bigint")


def jump(affine: tuple[int, int, int, int], p: int) -> tuple[int, int]:
    """(A, C) with state_p = A * state + C mod m, by squaring."""
    a, c, m, _ = affine
    x, y = 1, 0
    while p:
        if p & 1:
            x, y = a * x % m, (a * y + c) % m
        a, c, p = a * a % m, (a * c + c) % m, p >> 1
    return x, y


def reduced(f: Family, seed: int) -> int:
    """The state of an affine family before its first step."""
    return int(f.stepper(np.array([seed], np.int64)).x[0]) % f.affine[2]


# ---- affine jump-ahead -----------------------------------------------------------------------------------------------


def jumps(affine: tuple[int, int, int, int], positions: list[int]) -> dict[int, tuple[int, int]]:
    """(A, C) with state_p = A * seed + C mod m, for each position."""
    a, c, m, _ = affine
    want, out, x, y, p = set(positions), {}, 1, 0, 0
    while len(out) < len(want):
        if p in want:
            out[p] = (x, y)
        x, y, p = a * x % m, (a * y + c) % m, p + 1
    return out


def jumped(f: Family, seed: np.ndarray, a: int, c: int) -> np.ndarray:
    """Outputs after a jump, for a batch of reduced seeds; products wrap at 2^64, which a power-of-two modulus doesn't mind."""
    _, _, m, shift = f.affine
    x = seed * U64(a) + U64(c)
    x = x & U64(m - 1) if m & (m - 1) == 0 else x % U64(m)
    return (x >> U64(shift)) & M32


def affine_output(family: str, seed: Column, a: int, c: int) -> Column:
    """The output after a jump, in 24-bit limbs where the product would pass 63 bits (ANSI arithmetic must not overflow)."""
    _, _, m, shift = FAMILIES[family].affine
    if m == 1 << 48:
        lo24 = (1 << 24) - 1
        lo, hi = seed.bitwiseAND(F.lit(lo24)), F.shiftright(seed, 24).bitwiseAND(F.lit(lo24))
        cross = (lo * F.lit(a >> 24) + hi * F.lit(a & lo24)).bitwiseAND(F.lit(lo24))
        state = (lo * F.lit(a & lo24) + F.shiftleft(cross, 24) + F.lit(c)).bitwiseAND(F.lit(m - 1))
        return F.shiftright(state, shift).bitwiseAND(F.lit(0xFFFFFFFF))
    return (seed * F.lit(a) + F.lit(c)) % F.lit(m)


def affine_seed(family: str, seed: Column) -> Column:
    """The seed as the family takes it."""
    _, _, m, _ = FAMILIES[family].affine
    if m == 1 << 48:
        return seed.bitwiseAND(F.lit(m - 1))
    s = seed.bitwiseAND(F.lit(0xFFFFFFFF)) if family == "lcg32" else seed
    s = F.pmod(s, F.lit(m))
    return F.when(s == 0, F.lit(1)).otherwise(s) if family == "minstd" else s


def batches(it: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut frames to at most ``size`` rows."""
    for pdf in it:
        for i in range(0, len(pdf), size):
            yield pdf.iloc[i : i + size]


Expr = Callable[[Column], Column]
