"""Backoff tables: one histogram for all levels, the same quantiles whichever way a cell is computed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.operators import backoff, market

LEVELS = {"FINE": ("a", "b"), "A": ("a",), "B": ("b",), "ALL": ()}


def rows_and_cells(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice([None, rng.randint(1, 40), rng.random()])) for _ in range(900)]
    rows += [("hot", "p", i % 700) for i in range(3000)] + [("one", "r", 5)]
    cells = [(a, b) for a in ("x", "y", "z", "hot", "one", "none", None) for b in ("p", "q", "r", None, "none")]
    schema = "a string, b string, v double"
    return [(a, b, None if v is None else float(v)) for a, b, v in rows], cells, schema


def brute(rows, cell, probs, least):
    for (name, keys), needed in zip(LEVELS.items(), least):
        at = [i for i, k in enumerate(("a", "b")) if k in keys]
        values = [r[2] for r in rows if r[2] is not None and all(r[i] == cell[i] for i in at)]
        if len(values) >= needed:
            return name, len(values), *[float(np.quantile(values, q)) for q in probs]
    return None, None, *[None] * len(probs)


@pytest.mark.parametrize("state", [100_000, 50, 0])
def test_quantiles_against_plain_lists(spark, monkeypatch, state):
    monkeypatch.setattr(backoff, "STATE", state)
    rows, cells, schema = rows_and_cells(spark)
    train = spark.createDataFrame(rows, schema)
    target = spark.createDataFrame(cells, "a string, b string")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.9}
    for least in ([30, 30, 30, 1], [1, 1, 1, 10**6]):
        got = backoff.first_supported_quantiles(train, target, "v", LEVELS, probs, least).collect()
        assert len(got) == len(cells)
        for r in got:
            name, n, *values = brute(rows, (r.a, r.b), probs.values(), least)
            assert (r.level, r.support) == (name, n)
            assert [r.lo, r.mid, r.hi] == (values if name is None else pytest.approx(values))


def test_the_rows_are_read_once(spark, tmp_path):
    rows, cells, schema = rows_and_cells(spark)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/rows")
    train, target = spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame(cells, "a string, b string")
    out = market.backoff_quantiles(train, target, "v", LEVELS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString() and "Expand" not in plan


def test_an_empty_training_set(spark):
    _, cells, schema = rows_and_cells(spark)
    target = spark.createDataFrame(cells, "a string, b string")
    got = market.backoff_quantiles(spark.createDataFrame([], schema), target, "v", LEVELS).collect()
    assert {(r.backoff_value, r.backoff_support, r.backoff_level) for r in got} == {(0.0, 0, "ZERO_RESIDUAL_ANCHOR")}


def test_a_batch_as_one_cell_is_spread(spark, monkeypatch):
    monkeypatch.setattr(backoff, "STATE", 10)
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("session_key"), F.lit("r").alias("route"), (F.col("id") % 7).alias("price_vnd"),
        F.expr("timestamp_ntz'2026-05-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id % 2 AS INT))").alias("feature_time"),
        F.lit("2026-05-01").cast("date").alias("session_date"), F.lit("AM").alias("session_label"), F.lit("E").alias("collection_era"),
    )
    got = market.prior_batch_anchor(df, {"ROUTE": ("route",), "BATCH": ()}).select("session_key", "prior_anchor_vnd", "prior_anchor_support", "anchor_fallback_level").distinct().collect()
    assert [tuple(r) for r in got] == [(1, float(np.median([i % 7 for i in range(0, 400, 2)])), 200, "ROUTE")]
