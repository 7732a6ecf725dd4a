"""Generators against plain integer arithmetic; sieves against loops and planted seeds."""

import numpy as np
import pytest

from drawloom.operators import generators as G
from drawloom.operators import sieve as S

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
rotl = lambda x, k: ((x << k) | (x >> (64 - k))) & M64


def _lcg(a, c, m, shift):
    def g(seed):
        x = seed % m
        while True:
            x = (a * x + c) % m
            yield x >> shift & M32

    return g


def _xs32(seed):
    x = seed & M32
    while True:
        x ^= x << 13 & M32
        x ^= x >> 17
        x ^= x << 5 & M32
        yield x


def _xs128(seed):
    x, y, z, w = seed & M32, 362436069, 521288629, 88675123
    while True:
        t = (x ^ x << 11) & M32
        x, y, z, w = y, z, w, (w ^ w >> 19 ^ t ^ t >> 8) & M32
        yield w


def _xs64(seed):
    x = seed & M64
    while True:
        x ^= x >> 12
        x = (x ^ x << 25) & M64
        x ^= x >> 27
        x = x * 0x2545F4914F6CDD1D & M64
        yield x & M32


def _pcg(seed):
    x = seed & M64
    while True:
        o, x = x, (x * 6364136223846793005 + 1442695040888963407) & M64
        v, r = (o >> 18 ^ o) >> 27 & M32, o >> 59
        yield (v >> r | v << (32 - r) % 32) & M32


def _xoshiro(seed):
    s = [seed & M64, 0x9E3779B97F4A7C15, 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B]
    while True:
        yield (rotl((s[0] + s[3]) & M64, 23) + s[0]) & M64
        t = s[1] << 17 & M64
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rotl(s[3], 45)


def _sfc(seed):
    a, b, c, n = seed & M64, 0x9E3779B97F4A7C15, 0x6A09E667F3BCC908, 1
    while True:
        t = (a + b + n) & M64
        n, a, b, c = n + 1, b ^ b >> 11, (c + (c << 3)) & M64, (rotl(c, 24) + t) & M64
        yield t


def _philox(seed):
    n = 0
    while True:
        x, k = [n, 0, 0, 0], [seed & M32, seed >> 32 & M32]
        for _ in range(10):
            p, q = x[0] * 0xD2511F53, x[2] * 0xCD9E8D57
            x = [q >> 32 ^ x[1] ^ k[0], q & M32, p >> 32 ^ x[3] ^ k[1], p & M32]
            k = [(k[0] + 0x9E3779B9) & M32, (k[1] + 0xBB67AE85) & M32]
        n += 1
        yield x[0]


def _minstd(seed):
    yield from _lcg(48271, 0, 2147483647, 0)(seed % 2147483647 or 1)


def _mt(seed):
    b = np.random.MT19937()
    b._legacy_seeding(seed)
    while True:
        yield int(b.random_raw())


PLAIN = {
    "java_lcg": _lcg(25214903917, 11, 1 << 48, 16), "minstd": _minstd, "xorshift32": _xs32, "xorshift128": _xs128, "xorshift64": _xs64, "pcg32": _pcg,
    "xoshiro256pp": _xoshiro, "sfc64": _sfc, "philox4x32": _philox, "mt19937": _mt,
}


def _lcg32(seed):
    x = seed & M32
    while True:
        x = (1103515245 * x + 12345) % 0x7FFFFFFF
        yield x


PLAIN["lcg32"] = _lcg32


def take(g, n):
    return [next(g) for _ in range(n)]


@pytest.mark.parametrize("family", sorted(G.FAMILIES))
def test_outputs(family):
    bits = G.FAMILIES[family].seed_bits
    rng = np.random.default_rng(1)
    n = 5 if family == "mt19937" else 100
    seeds = np.array([0, 1, 12345, (1 << min(bits, 62)) - 1, *rng.integers(0, 1 << min(bits, 62), n)])
    out = G.sequences(family, seeds, 700 if family == "mt19937" else 500, skip=3)
    for s, row in zip(seeds, out):
        assert row.tolist() == take(PLAIN[family](int(s)), len(row) + 3)[3:]


@pytest.mark.parametrize("family", ["java_lcg", "minstd", "lcg32", "xorshift32", "pcg32"])
@pytest.mark.parametrize("reverse", [False, True])
def test_fixed_skip_against_a_loop_and_a_planted_seed(spark, family, reverse):
    k, skip, planted = 9, 4, 777
    seq = take(PLAIN[family](planted), 100)
    values = [seq[p - 1] % 1000 for p in S.positions(k, skip, offset=2)]
    got = {r.seed: (r.matches, r.best_skip) for r in S.fixed_skip(S.seed_space(spark, 0, 1500), values, family, (0, 6), 1 / 9, offset=2, reverse=reverse).collect()}
    want, v = {}, values[::-1] if reverse else values
    for s in range(1500):
        seq = take(PLAIN[family](s), 100)
        n = [sum(seq[p - 1] % 1000 == x for p, x in zip(S.positions(k, t, 2), v)) for t in range(7)]
        if max(n) >= 1:
            want[s] = (max(n), n.index(max(n)))
    assert got == want and (reverse or got[planted] == (k, skip))


def _hybrid_loop(g, values, most, tol, on_miss):
    """One seed, one strategy, on the list of its outputs."""
    out, at, e, hits, missed, pat = g, 0, 5, 0, 0, []
    for v in values:
        lo, hi = max(0, e - tol), e + tol
        s = next((s for s in range(lo, hi + 1) if out[at + s] % 1000 == v), None)
        pat.append(e if s is None else s)
        if s is not None:
            hits, missed, at = hits + 1, 0, at + s + 1
            e = s if on_miss != "step" else e
        else:
            missed += 1
            at += {"drift": hi, "stay": 0, "step": 1}[on_miss]
            if missed >= most + (on_miss == "step"):
                break
    return hits, pat


@pytest.mark.parametrize("on_miss", ["drift", "stay", "step"])
@pytest.mark.parametrize("family", ["java_lcg", "xorshift128"])
def test_hybrid_against_a_loop(spark, on_miss, family):
    skips = [5, 7, 3, 6, 5, 8, 4, 9]
    seq, at, values = take(PLAIN[family](42), 400), 0, []
    for s in skips:
        values.append(seq[at + s] % 1000)
        at += s + 1
    values[3] = 999
    strategies = [("a", 3, 5), ("b", 2, 9)]
    got = {r.seed: (r.matches, r.strategy_id, r.skip_pattern) for r in S.hybrid(S.seed_space(spark, 0, 200), values, family, 1 / 8, strategies, on_miss).collect()}
    want = {}
    for s in range(200):
        outs, best = take(PLAIN[family](s), 600), (0, 0, [])
        for i, (_, most, tol) in enumerate(strategies):
            h, p = _hybrid_loop(outs, values, most, tol, on_miss)
            if h > best[0]:
                best = (h, i, p)
        if best[0] >= 1:
            want[s] = best
    assert got == want and got[42][0] >= 3


def test_two_phase_digit_and_accumulate(spark):
    seq = take(PLAIN["java_lcg"](321), 200)
    values = [seq[p - 1] % 1000 for p in S.positions(8, 5)]
    two = S.two_phase(S.seed_space(spark, 0, 1000), values, "java_lcg", (0, 8)).collect()
    assert [(r.seed, r.matches) for r in two] == [(321, 8)]
    d = [100 * (seq[7 * i + 4] % 10) + 10 * (seq[7 * i + 5] % 10) + seq[7 * i + 6] % 10 for i in range(6)]
    best = S.digit_sequential(S.seed_space(spark, 0, 400), d, "java_lcg", (0, 6)).orderBy("partial_matches", ascending=False).first()
    assert (best.seed, best.full_matches, best.best_skip) == (321, 6, 4)
    store = spark.createDataFrame([(1, 0.5, "old"), (2, 0.5, "old")], "seed long, score double, o string")
    new = spark.createDataFrame([(1, 0.5, "new"), (2, 0.6, "new"), (3, 0.1, "new"), (3, 0.2, "new2")], "seed long, score double, o string")
    assert {r.seed: r.o for r in S.accumulate(store, new).collect()} == {1: "old", 2: "new", 3: "new2"}


def test_jumps_equal_steps_and_long_products(spark):
    from pyspark.sql import functions as F

    for family in ("java_lcg", "minstd", "lcg32"):
        j = G.jumps(G.FAMILIES[family].affine, [1, 7, 500])
        seeds = [0, 1, 2**31 - 1, 2**32 - 1, 2**47 + 12345]
        df = spark.createDataFrame([(s,) for s in seeds], "seed long")
        cols = [G.affine_output(family, G.affine_seed(family, F.col("seed")), *j[p]).alias(f"p{p}") for p in j]
        for r in df.select("seed", *cols).collect():
            seq = take(PLAIN[family](r.seed), 500)
            assert [r.p1, r.p7, r.p500] == [seq[0], seq[6], seq[499]]
