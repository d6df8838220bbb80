"""Blends and metrics per task, class support of splits, samplers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.operators import metrics, selection, splits


def test_blends_of_numbers_and_arrays(spark):
    df = spark.createDataFrame([(1, 0.2, 0.6, 1.0, [1.0, 2.0], [3.0, 4.0], [5.0, 10.0])], "i int, a double, b double, c double, qa array<double>, qb array<double>, qc array<double>")
    numbers = {r.recipe: r.value for r in metrics.blends(df, "a", "b", "c").collect()}
    assert numbers == pytest.approx({"INCUMBENT": 1.0, "FIRST": 0.2, "SECOND": 0.6, "MEAN": 0.4, "BLEND_25": 0.85, "BLEND_50": 0.7, "BLEND_75": 0.55})
    arrays = {r.recipe: r.value for r in metrics.blends(df, "qa", "qb", "qc").collect()}
    assert arrays["MEAN"] == [2.0, 3.0] and arrays["BLEND_25"] == [4.25, 8.25]


def test_scores_of_every_task(spark):
    rng = np.random.default_rng(4)
    levels = np.array([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95])
    rows = [("R", "SCREEN", "F1", i, f"q{i % 7}", float(rng.integers(1, 50)), float(rng.integers(1, 50)), rng.normal(size=7).tolist(), float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "recipe string, fold_set string, fold string, offer_id int, query_id string, y double, value double, quantiles array<double>, r double")
    y, v = (np.array([r[i] for r in rows]) for i in (5, 6))
    got = metrics.recipe_scores(df, "POINT", "y").first().score
    assert got == pytest.approx(np.mean(np.abs(v - y) / y))
    q = np.sort(np.array([r[7] for r in rows]), axis=1)
    e = np.array([r[8] for r in rows])[:, None] - np.maximum.accumulate(np.array([r[7] for r in rows]), axis=1)
    pinball = np.maximum(levels * e, (levels - 1) * e).mean(axis=1)
    got = metrics.recipe_scores(df.drop("value").withColumnRenamed("quantiles", "value"), "DISTRIBUTION", "r").first().score
    e2 = np.array([r[8] for r in rows])[:, None] - q
    assert got == pytest.approx(2 * pinball.mean()) or got == pytest.approx(2 * np.maximum(levels * e2, (levels - 1) * e2).mean())
    per_query = metrics.ndcg(df.withColumn("s", F.col("value")), "s", "y").agg(F.avg("ndcg5")).first()[0]
    assert metrics.recipe_scores(df, "RANKING", "y").first().score == pytest.approx(per_query)


@pytest.mark.parametrize("late, worst, expected", [(0.99, 0.99, ("NEW", "NEW", "PASS")), (1.5, 1.0, ("NEW", "INCUMBENT", "RETAIN_INCUMBENT"))])
def test_the_winner_of_the_screen_must_pass_the_late_gate(spark, late, worst, expected):
    schema = "recipe string, screen double, late double, late_worst_fold double, selection_score double"
    table = spark.createDataFrame([("INCUMBENT", 1.0, 1.0, 1.0, 1.0), ("NEW", 0.9, late, worst, 0.9), ("OLD", 0.9, 9.0, 9.0, 0.9)], schema)
    assert tuple(metrics.choose_recipe(table, "CLASSIFICATION").first()) == expected
    same = table.where("recipe = 'INCUMBENT'")
    assert tuple(metrics.choose_recipe(same, "CLASSIFICATION").first()) == ("INCUMBENT", "INCUMBENT", "INCUMBENT_WON_SCREEN")


def test_calibration_split_needs_both_classes(spark):
    rows = [("F1", i, int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "fold string, d int, y int").select(
        "fold", "y", F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, d)").alias("feature_time"), F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, d, 1)").alias("label_time")
    )
    parts = {r.part: r["count"] for r in splits.calibration_split(df, target="y").groupBy("part").count().collect()}
    assert parts == {"FIT": 48, "CALIBRATION": 12}
    one = df.withColumn("y", F.when(F.col("feature_time") > "2026-02-10", 1).otherwise(F.col("y")))
    with pytest.raises(Exception, match="both classes"):
        splits.calibration_split(one, target="y").collect()


@pytest.mark.parametrize("pushed", [1000, 3])
def test_quotas_and_even_spacing(spark, monkeypatch, pushed):
    monkeypatch.setattr(selection, "PUSHED", pushed)
    rng = random.Random(6)
    rows = [(f"2026-01-{d:02d}", rng.randint(0, 1), i * 31 + d, rng.random()) for i in range(60) for d in range(1, 31)]
    df = spark.createDataFrame(rows, "d string, y int, k int, v double")
    dates = sorted({r[0] for r in rows})[-24:]
    recent = [r for r in rows if r[0] in dates]
    quota = max(8, 480 // len({r[:2] for r in recent}))
    expected = {r[2] for g in {r[:2] for r in recent} for r in sorted((r for r in recent if r[:2] == g), key=lambda r: r[2])[:quota]}
    assert {r.k for r in selection.balanced_recent(df, "d", "y", "k", 480).collect()} == expected
    for target in ("v", "one"):
        got = selection.balanced_recent(df.withColumn("one", F.lit(1)), "d", target, "k", 100).collect()
        order = sorted(r[2] for r in recent)
        assert {r.k for r in got} == {order[i] for i in np.linspace(0, len(order) - 1, 100, dtype=np.int64)}
