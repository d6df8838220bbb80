"""What keeps the ranking, audit and model jobs small: columns, joins and tables they do without."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farepanel.operators import audits, metrics, scale
from farepanel.plans import models_q
from farepanel.sources import panel as source


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [100_000, 20])
def test_running_totals_with_ties_and_expressions(spark, monkeypatch, bound):
    monkeypatch.setattr(scale, "BUCKET_VALUES", bound)
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", rng.randint(1, 60), d, rng.randint(1, 4)) for i in range(90) for d in (0, 1)]
    hist = spark.createDataFrame(rows, "k string, v int, d int, n int").groupBy("k", "v", "d").agg(F.sum("n").alias("n"))
    got = scale.running_totals(hist, ["k"], "v", {"odd": F.when(F.col("d") == 1, F.col("n")).otherwise(0)}, ["d"])
    if bound == 100_000:  # no key is large: one window is enough
        assert "Join" not in plan_of(got)
    for r in got.collect():
        same = [x for x in rows if x[0] == r.k and x[2] == 1]
        assert r.odd_before == sum(x[3] for x in same if (x[1], x[2]) < (r.v, r.d)) and r.odd_total == sum(x[3] for x in same)


@pytest.mark.parametrize("bound", [100_000, 20])
def test_concordance_of_many_levels(spark, monkeypatch, bound):
    monkeypatch.setattr(scale, "BUCKET_VALUES", bound)
    rng = random.Random(6)
    rows = [("q", i, rng.choice([None, *range(1, 40)]), rng.randint(1, 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id string, offer_id long, price long, score long")
    (got,) = metrics.concordance(df, "score", "price").collect()
    known = [r for r in rows if r[2] is not None]
    pairs = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if a[2] != b[2]]
    assert got.informative_pairs == len(pairs)
    assert got.concordance == pytest.approx(sum((a[2] < b[2]) == (a[3] > b[3]) and a[3] != b[3] for a, b in pairs) / len(pairs))


def test_recipes_rank_fares_once(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("SCREEN", f"F{i % 2}", f"q{i % 5}", i, float(rng.randint(1, 20)), rng.random(), rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "fold_set string, fold string, query_id string, offer_id long, y double, a double, b double, c double")
    long = metrics.blends(df, "a", "b", "c")
    flat = lambda t: {(r.recipe, r.fold): pytest.approx(r.score) for r in t.collect()}
    want = flat(metrics.recipe_scores(long, "RANKING", "y"))
    ranked, real = [], scale.histogram
    monkeypatch.setattr(scale, "histogram", lambda t, *a, **k: ranked.append(t.count()) or real(t, *a, **k))
    assert flat(metrics.recipe_scores(long, "RANKING", "y", rows=df)) == want and len(want) == 14
    assert ranked == [len(rows)]


def test_spearman_joins_a_column_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = [tuple(None if rng.random() < 0.2 else float(rng.randint(1, 30)) for _ in range(4)) for _ in range(300)]
    df, calls, real = spark.createDataFrame(rows, "a double, b double, c double, d double"), [], scale.running_totals
    monkeypatch.setattr(audits, "running_totals", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {(r.feature_left, r.feature_right): (r.rows, r.spearman) for r in audits.spearman_pairs(df, list("abcd")).collect()}
    frame = pd.DataFrame(rows, columns=list("abcd"))
    for (x, y), (n, value) in got.items():
        part = frame[[x, y]].dropna().rank()
        assert n == len(part) and value == pytest.approx(part[x].corr(part[y]))
    assert len(got) == 6 and len(calls) == 4
    assert audits.spearman_pairs(df.where("a is null"), ["a", "b"]).collect() == []


def test_summary_and_frame_leave_the_wide_table_unwritten(spark, tmp_path):
    folder = str(tmp_path / "sf")
    os.symlink("/root/testdata/sf0.001", folder)
    from farepanel.plans import load

    assert load()[0]["frame_summary"](spark, folder).count() > 5
    p = source.Panel(spark, folder)
    first, again = models_q.model_frame(p), models_q.model_frame(source.Panel(spark, folder))
    assert first.inputFiles() == again.inputFiles() and "fold_set" in first.columns
    names = {key[2] for key in source._STORED if key[1] == folder}
    assert "frame" in names and "featured" not in names
