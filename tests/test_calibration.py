"""Monotone calibration and shrinkage strengths against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.operators import calibration, rates, scale


def plain_pav(x, y):
    """(lo, hi, weight, sum) blocks by the usual stack over sorted distinct scores."""
    points = {}
    for a, b in zip(x, y):
        w, s = points.get(a, (0, 0.0))
        points[a] = (w + 1, s + b)
    blocks = []
    for a in sorted(points):
        w, s = points[a]
        block = [a, a, w, s]
        while blocks and blocks[-1][3] / blocks[-1][2] >= block[3] / block[2]:
            last = blocks.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        blocks.append(block)
    return blocks


def fitted(spark, x, y, parts):
    df = spark.createDataFrame(list(zip(map(float, x), y)), "raw double, y int").repartition(5)
    model = calibration.fit_isotonic(df, "y", "raw", parts)
    return model, sorted((r.lo, r.hi, r.w, r.mean) for r in model.collect())


@pytest.mark.parametrize("shape", ["rising", "falling", "flat", "noise", "steps"])
@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_equal_plain_pooling(spark, shape, parts):
    rng = random.Random(shape)
    x = [rng.choice([round(rng.gauss(0, 2), 1), rng.gauss(0, 2)]) for _ in range(800)]
    chance = {"rising": lambda a: 1 / (1 + math.exp(-a)), "falling": lambda a: 1 / (1 + math.exp(a)), "flat": lambda a: 0.0, "noise": lambda a: 0.5, "steps": lambda a: float(a > 0)}[shape]
    y = [int(rng.random() < chance(a)) for a in x]
    _, got = fitted(spark, x, y, parts)
    assert got == [(lo, hi, float(w), pytest.approx(s / w)) for lo, hi, w, s in plain_pav(x, y)]


def test_a_hundred_thousand_distinct_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=100_000)
    y = (rng.random(100_000) < 1 / (1 + np.exp(-x))).astype(int)
    model, got = fitted(spark, x.tolist(), y.tolist(), 16)
    expected = plain_pav(x.tolist(), y.tolist())
    assert [g[:3] for g in got] == [(lo, hi, float(w)) for lo, hi, w, _ in expected]
    at = np.r_[-50.0, rng.normal(size=2000), 50.0, x[:500]]
    ends = np.array([e for lo, hi, _, _ in expected for e in ((lo, hi) if lo < hi else (lo,))])
    means = np.array([s / w for lo, hi, w, s in expected for _ in range(2 if lo < hi else 1)])
    out = calibration.apply_isotonic(model, spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)], "i long, raw double"), "raw", "p").orderBy("i").collect()
    assert np.allclose([r.p for r in out], np.interp(at, ends, means), atol=1e-12)
    assert all(a.p <= b.p + 1e-12 for a, b in zip(sorted(out, key=lambda r: r.raw), sorted(out, key=lambda r: r.raw)[1:]))


def test_nulls_one_score_and_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (None, 1), (2.0, None)], "raw double, y int")
    model = calibration.fit_isotonic(df, "y", "raw")
    assert [tuple(r) for r in model.collect()] == [(1.0, 1.0, 2.0, 0.5)]
    out = calibration.apply_isotonic(model, df, "raw", "p").collect()
    assert sorted((str(r.raw), r.p) for r in out) == [("1.0", 0.5), ("1.0", 0.5), ("2.0", 0.5), ("None", None)]


def test_recipes_without_a_monotone_map(spark):
    few = spark.createDataFrame([(i / 10.0, i % 2) for i in range(-20, 20)], "raw double, y int")
    out = calibration.with_probability_recipes(few, few, "y", "raw")
    columns = calibration.recipe_columns(out)
    assert list(columns) == ["SIGMOID", "PLATT", "BETA"]
    assert calibration.choose_probability_recipe(out, "y", columns).where("chosen").count() == 1


def test_nearest_points_over_many_buckets(spark):
    rng = random.Random(4)
    points = sorted(rng.sample(range(-500, 500), 60))
    queries = [rng.uniform(-700, 700) for _ in range(300)] + [float(p) for p in points[:20]] + [0.0]
    near = scale.neighbours(
        spark.createDataFrame([(q,) for q in queries], "x double"), spark.createDataFrame([(float(p), i) for i, p in enumerate(points)], "x double, v int"), "x", "v"
    ).collect()
    assert len(near) == len(set(queries))
    for r in near:
        below, above = [p for p in points if p <= r.x], [p for p in points if p > r.x]
        assert (r.below.x if r.below else None, r.above.x if r.above else None) == (below[-1] if below else None, above[0] if above else None)


def test_log_gamma_is_exact(spark):
    values = [1e-6, 1e-3, 0.5, 1.0, 1.5, 2.0, 7.999999, 8.0, 8.5, 30.0, 1e3, 1e5, 1e8] + [random.Random(1).uniform(0.01, 50) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", rates.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11) for r in rows)


def test_strength_has_the_largest_likelihood(spark):
    rng = np.random.default_rng(3)
    cells = [(float(rng.binomial(n, p)), float(n), 0.3) for n, p in zip(rng.integers(5, 80, 300), rng.beta(0.3 * 25, 0.7 * 25, 300))]

    def likelihood(log_kappa):
        lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
        kappa = math.exp(log_kappa)
        return sum(lb(k + m * kappa, n - k + (1 - m) * kappa) - lb(m * kappa, (1 - m) * kappa) for k, n, m in cells)

    a, b, ratio = math.log(0.1), math.log(1e5), (math.sqrt(5) - 1) / 2
    while b - a > 1e-7:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if likelihood(c) > likelihood(d) else (c, b)
    df = spark.createDataFrame(cells, "k double, n double, m double")
    assert math.log(rates.estimate_kappa(df, "k", "n", "m", "kappa").first().kappa) == pytest.approx(a, abs=2e-5)
    plan = df.select(rates.beta_binomial(F.col("k"), F.col("n"), F.col("m"), F.lit(2.0)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert rates.estimate_kappa(df.limit(1), "k", "n", "m", "kappa").first().kappa == 100.0
