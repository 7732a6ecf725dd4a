"""Scalar functions, searches, survivors' scores and reverse hybrids."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.functions import scalars as C
from drawloom.functions import stats
from drawloom.operators import generators as G
from drawloom.operators import sieve as S
from drawloom.plans import search


def test_inverses_and_squashing(spark):
    d = spark.createDataFrame([(p,) for p in (0.0001, 0.02, 0.3, 0.5, 0.9, 0.99999, 0.0, 1.0)], "p double")
    for r in d.select("p", C.inverse_normal(F.col("p")).alias("z"), C.inverse_erf(2 * F.col("p") - 1).alias("e")).collect():
        if r.p in (0.0, 1.0):
            assert r.z is None
        else:
            assert abs(0.5 * math.erfc(-r.z / math.sqrt(2)) - r.p) < 1e-8 and abs(math.erf(r.e) - (2 * r.p - 1)) < 1e-7
    z = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.7, 30.0)], "z double")
    for r in z.select("z", stats.normal_cdf(F.col("z")).alias("c"), C.sigmoid(F.col("z")).alias("s")).collect():
        assert abs(r.c - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-7 and 0 < r.s <= 1
    m = spark.createDataFrame([(3, 10), (4, 10), (7, 2147483647)], "a long, m long").select("a", "m", C.modular_inverse("a", "m").alias("i")).collect()
    assert [r.i for r in m[:2]] == [7, None] and 7 * m[2].i % 2147483647 == 1
    g = spark.createDataFrame([(12,), (18,), (None,), (30,)], "v int")
    assert C.gcd_of(g, "v").first().gcd == 6 and C.gcd_of(g.where("false"), "v").first().gcd == 0


def test_vectors(spark):
    a, b = [1.0, 2.0, 4.0], [2.0, 1.0, 7.0]
    r = spark.createDataFrame([(a, b, [0.0] * 3)], "a array<double>, b array<double>, z array<double>").select(C.cosine("a", "b").alias("c"), C.pearson("a", "b").alias("p"), C.inverse_euclid("a", "b").alias("e"), C.cosine("a", "z").alias("n"), C.softmax("a").alias("s")).first()
    x, y = np.array(a), np.array(b)
    assert abs(r.c - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12 and abs(r.p - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert abs(r.e - 1 / (1 + np.linalg.norm(x - y))) < 1e-12 and r.n is None and abs(sum(r.s) - 1) < 1e-12


def test_entropy_and_chi_square_with_absent_classes(spark):
    c = spark.createDataFrame([(0, 30), (1, 50), (2, 20)], "r int, n long")
    p = (np.array([30, 50, 20, 0]) / 100 + 1e-10) / (1 + 4e-10)
    assert abs(stats.entropy_smoothed(c, 4).first().entropy + (p * np.log(p)).sum() / math.log(4)) < 1e-12
    r = stats.chi_square(c, 4).first()
    assert abs(r.chi2 - ((np.array([30, 50, 20, 0]) - 25) ** 2 / 25).sum()) < 1e-9 and r.p_value < 1e-6


@pytest.mark.parametrize("sampler", [search.random_sampler, search.parzen_sampler, search.ucb_sampler])
def test_samplers_stay_in_bounds(sampler):
    b, rnd, seen = search.Bounds(), random.Random(3), []
    for i in range(12):
        c = sampler(b, seen, rnd)
        assert b.valid(c)
        seen.append((c, float(c.window_size)))


def test_search_finds_rows_and_prunes(spark):
    d = spark.range(200).selectExpr("id AS idx", "(id * 7919) % 1000 AS draw", "'midday' AS session")
    t = search.search(spark, d, S.seed_space(spark, 0, 500), "minstd", 3, seed=2).collect()
    assert [r.trial_number for r in t] == [0, 1, 2] and all(r.best_so_far >= r.score for r in t)
    none = search.run_trial(d, S.seed_space(spark, 0, 50), "minstd", search.Config(30, 0, 0, 1, 0.9, 0.9))
    assert none["pruned"] and none["bidirectional_count"] == 0


def test_reverse_hybrid_validation_and_votes(spark):
    seq = (G.sequences("java_lcg", np.array([55]), 80)[0] % G.U64(1000)).tolist()
    at, vals = 0, []
    for s in (2, 0, 3, 1, 2, 0):
        vals.append(seq[at + s])
        at += s + 1
    got = S.hybrid_reverse(S.seed_space(spark, 0, 100), vals[::-1], "java_lcg", 1.0, strategies=[("a", 1, 3)]).collect()
    assert [(r.seed, r.matches, r.strategy_id) for r in got] == [(55, 6, 0)]
    values = [seq[p - 1] for p in S.positions(8, 3)]
    v = S.validate_survivors(S.seed_space(spark, 50, 60), values, "java_lcg", (0, 5)).orderBy(F.desc("score")).first()
    assert (v.seed, v.best_skip, v.longest_run, v.score) == (55, 3, 8, 1.0)
    n = S.predict_next(spark.createDataFrame([(55, 0.5)], "seed long, score double"), "java_lcg", 4).first()
    assert (n.number, n.weight) == (seq[3], 0.5)
