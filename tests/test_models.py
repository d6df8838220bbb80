"""Candidate screens and boosted quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.functions import columns as K
from farepanel.operators import market, models
from farepanel.operators.scale import histogram, quantiles_of_totals, running_totals


def frame(spark, n=4000, seed=1):
    """Log changes that depend on an interaction the backoff keys do not hold, in place and in spread."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        route, airline, minute, price = f"r{i % 4}", rng.choice("ab"), rng.randrange(0, 1440), rng.randrange(500, 3000) * 1000
        late, dear = minute > 720, price > 1_700_000
        y = (0.3 if late == dear else -0.3) + rng.gauss(0, 0.02 if late else 0.15)
        rows.append((i, route, airline, rng.choice(["AM", "PM"]), 7, minute, price, 100, price + rng.randrange(1000), price, rng.random(), y, int(y < 0), 7, "EVENING" if late else "MORNING"))
    schema = (
        "offer_id long, route string, airline string, session_label string, days_until_departure int, departure_minute int, price_vnd long, batch_offer_count long, "
        "temporal_market_median_price double, previous_price_same_schedule double, prior_relative_volatility double, y double, drop int, target_dud int, departure_period string"
    )
    rows = [(*r[:8], float(r[8]), float(r[9]), *r[10:]) for r in rows]
    return spark.createDataFrame(rows, schema)


def test_boosted_quantiles_beat_the_backoff_table(spark):
    df = frame(spark)
    train, late = df.where("offer_id % 4 < 3"), df.where("offer_id % 4 = 3")
    model = models.fit_quantile_boost(train, "y", stages=6, rate=0.5)
    out = models.predict_quantiles(model, late)
    assert out.columns == [*late.columns, "quantiles"] and out.count() == late.count()
    wis = lambda rows, q: rows.agg(F.avg(K.wis("y", q))).first()[0]
    table = models.quantile_surface(train, late, "y")
    assert wis(out, "quantiles") < 0.6 * wis(table, "surface")
    inside = out.agg(F.avg(((F.col("y") >= F.col("quantiles")[0]) & (F.col("y") <= F.col("quantiles")[6])).cast("double"))).first()[0]
    assert 0.8 < inside < 0.98
    assert all(sum(len(s) for s in steps.values()) <= 7 * 2**4 for _, steps in model.stages)
    assert "__HIST" not in table.columns and market.RESIDUAL_LEVELS


@pytest.mark.parametrize("accuracy", [20, 50])
def test_a_leaf_keeps_few_values_and_its_exact_quantiles(spark, accuracy):
    levels = (0.05, 0.5, 0.95)
    rng = np.random.default_rng(4)
    y, leaf = np.round(rng.normal(size=9000), 3), rng.integers(0, 3, 9000)
    leaf[:30] = 7
    rows = [(float(l), [0.1, 0.0, -0.1], float(v)) for l, v in zip(leaf, y)]
    left = models._leaf_rests(spark.createDataFrame(rows, "__leaf double, __q array<double>, __y double"), levels, accuracy)
    assert left.count() == 27_000
    assert left.where("abs(__rest) < 100 AND __leaf <> 7").count() < 0.3 * 27_000
    share = K.lookup("__level", dict(enumerate(levels)))
    totals = running_totals(histogram(left, ["__leaf", "__level"], "__rest"), ["__leaf", "__level"], "__rest", ["n"])
    for r in quantiles_of_totals(totals, ["__leaf", "__level"], "__rest", {"step": share}).collect():
        want = np.quantile(y[leaf == r["__leaf"]] - [0.1, 0.0, -0.1][r["__level"]], levels[r["__level"]])
        assert r["step"] == pytest.approx(want, abs=1e-12)


def test_losers_must_lose_every_fold():
    scores = {"best": [0.5, 0.5, 0.5], "close": [0.505, 0.505, 0.505], "once": [0.4, 0.9, 0.9], "worse": [0.6, 0.6, 0.51]}
    assert models.losers(scores, 0.01) == {"worse"}
    assert models.losers({"only": [1.0]}, 0.0) == set()


@pytest.mark.parametrize("pools", [(1, 4)])
def test_the_grid_does_not_depend_on_the_pool_and_ends_losers(spark, pools):
    df = frame(spark, 900, 3).withColumn("fold", F.explode(F.array(F.lit("F1"), F.lit("F2"), F.lit("F3"))))
    split = df.withColumn("role", F.when(F.pmod(F.hash("offer_id", "fold"), F.lit(3)) == 0, "VALID").otherwise("TRAIN"))
    grid = {"TREES": {"trees": 8, "depth": 3}, "LINE": {"family": "LOGISTIC"}}
    tables = [sorted(map(tuple, models.candidate_grid(split, "drop", grid, ["F1", "F2", "F3"], [1, 2], pool=p).collect())) for p in pools]
    assert tables[0] == tables[1]
    assert {(r[0], r[1]) for r in tables[0]} == {("F1", "TREES"), ("F2", "TREES"), ("F3", "TREES"), ("F1", "LINE"), ("F2", "LINE")}


def test_the_grid_fits_a_learner_without_draws_once(spark, monkeypatch):
    df = frame(spark, 900, 3).withColumn("fold", F.when(F.col("offer_id") < 300, "F1").otherwise("F2"))
    split = df.withColumn("role", F.when(F.pmod(F.hash("offer_id"), F.lit(3)) == 0, "VALID").otherwise("TRAIN"))
    fits, real = [], models.LogisticRegression.fit

    def fit(self, rows):
        fits.append(rows.count())
        return real(self, rows)

    monkeypatch.setattr(models.LogisticRegression, "fit", fit)
    rows = models.candidate_grid(split, "drop", {"LINE": {"family": "LOGISTIC"}}, ["F1", "F2"], [1, 2, 3]).collect()
    assert len(fits) == 2
    assert sorted((r.fold, r.seed) for r in rows) == [(f, s) for f in ("F1", "F2") for s in (1, 2, 3)]
    assert all(len({(r.rows, r.proper_score) for r in rows if r.fold == f}) == 1 for f in ("F1", "F2"))
