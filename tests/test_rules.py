"""Hand-worked cases of gates, splits, weights, ordered numbers and the store."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import calibration, metrics, policy, quality, scale, splits
from farepanel.sources import files


@pytest.mark.parametrize(
    "task, late, worst, passes",
    [
        ("CLASSIFICATION", 1.0099, 1.0149, (True, True)),
        ("CLASSIFICATION", 1.0101, 1.0151, (False, False)),
        ("POINT", 1.0199, 1.031, (True, False)),
        ("DISTRIBUTION", 1.031, 1.04, (False, True)),
        ("RANKING", 0.9901, 0.9851, (True, True)),
        ("RANKING", 0.9899, 0.9849, (False, False)),
    ],
)
def test_late_gate_tolerances(spark, task, late, worst, passes):
    table = spark.createDataFrame([("INCUMBENT", 1.0, 1.0), ("NEW", late, worst)], "recipe string, late double, late_worst_fold double")
    row = metrics.late_gate(table, task).where("recipe = 'NEW'").first()
    assert (row.pass_mean, row.pass_worst_fold) == passes and row.late_pass == all(passes)


def test_recipe_table_direction(spark):
    folds = spark.createDataFrame(
        [("A", "SCREEN", 0.2), ("A", "SCREEN", 0.4), ("A", "LATE", 0.5), ("A", "LATE", 0.1)], "recipe string, fold_set string, score double"
    )
    low, high = metrics.recipe_table(folds, "POINT").first(), metrics.recipe_table(folds, "RANKING").first()
    assert (low.screen_worst_fold, low.late_worst_fold, round(low.selection_score, 9)) == (0.4, 0.5, 0.3)
    assert (high.screen_worst_fold, high.late_worst_fold, round(high.selection_score, 9)) == (0.2, 0.1, -0.3)


def test_release_gates_allow_equality_and_five_percent_of_tail(spark):
    equal = dict(
        failed_blocks=0, proper_score=0.5, base_proper_score=0.5, mape=0.1, base_mape=0.1, wis=0.2, base_wis=0.2, crossing_rate=0.0, ndcg5=0.8,
        base_ndcg5=0.8, mean_regret=10.0, buy_all_regret=10.0, cvar95_regret=106.0, buy_all_cvar95=100.0, recipes=1, row_overlap=0, query_overlap=0,
    )
    gates = lambda **changed: metrics.release_gates(spark.createDataFrame([{**equal, **changed}])).first()
    assert gates().passed == 10
    assert not gates(cvar95_regret=106.1).cvar_close_to_buy_all
    assert not gates(crossing_rate=0.001).quantiles_coherent
    assert not gates(query_overlap=1).blocks_disjoint and not gates(recipes=2).recipe_unchanged


def batch(spark, drop_airline=0, windows=C.BOOKING_WINDOWS, label="AM", repeat=False, odd=None):
    rows = [
        (dt.date(2026, 5, 1), label, f"{r}{a}{w}", f"R{r}", a, w)
        for r in range(20) for a in C.AIRLINES[drop_airline:] for w in windows
    ]
    rows += rows[:1] * repeat + ([(dt.date(2026, 5, 1), label, "odd", "R0", C.AIRLINES[-1], odd)] if odd else [])
    schema = "session_date date, session_label string, schedule_slot_id string, route string, airline string, days_until_departure int"
    return spark.createDataFrame(rows, schema)


def test_batch_contract(spark):
    status = lambda df, subset=None: quality.validate_batches(df, subset=subset).first().status
    morning = F.col("session_label") == "AM"
    assert status(batch(spark)) == "READY"
    assert status(batch(spark, repeat=True)) == "READY"
    assert status(batch(spark, drop_airline=1)) == "FAILED"
    assert status(batch(spark, drop_airline=1), morning) == "READY"
    assert status(batch(spark, drop_airline=2), morning) == "FAILED"
    assert status(batch(spark, drop_airline=1, label="PM"), morning) == "FAILED"
    assert status(batch(spark, windows=C.BOOKING_WINDOWS[1:])) == "FAILED"
    assert status(batch(spark, odd=999)) == "FAILED"


def test_collector_logs_are_read_from_files(spark, tmp_path):
    logs = {
        "good": "x START queries=220\nnoise\ny END rows=900 skipped=0/220\n",
        "skipped": "START queries=220\nEND rows=9 skipped=1/220",
        "short": "START queries=219\nEND rows=9 skipped=0/219",
        "open": "START  queries=220\n",
    }
    for name, text in logs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.txt").write_text(text)
    got = {r.file: r for r in files.log_audit(files.read_log(spark, f"{tmp_path}/*")).collect()}
    assert {n: r.complete for n, r in got.items()} == {"good": True, "skipped": False, "short": False, "open": False}
    assert (got["good"].started, got["good"].reported_rows, got["good"].skipped, got["good"].completed) == (220, 900, 0, 220)


def test_safety_floors(spark):
    def safe(unsafe, buys, caught, missed_waits=0, calm_waits=0):
        rows = [(False, 1)] * unsafe + [(False, 0)] * (buys - unsafe) + [(True, 1)] * caught + [(True, 0)] * calm_waits
        return policy.wilson_safety(spark.createDataFrame(rows, "wait boolean, drop_5pct int")).first()

    assert safe(5, 200, 100).safe
    assert not safe(40, 200, 400).safe  # upper bound above 0.15
    assert not safe(1, 50, 100, calm_waits=300).safe  # buys below 0.20
    row = safe(30, 400, 60)
    assert row.wait_recall == pytest.approx(60 / 90) and not row.safe


def test_splits_with_too_few_dates_fail(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("F1", start + dt.timedelta(days=i), start + dt.timedelta(days=i, hours=1)) for i in range(8)]
    train = spark.createDataFrame(rows, "fold string, feature_time timestamp_ntz, label_time timestamp_ntz")
    with pytest.raises(Exception, match="too few dates"):
        splits.inner_split(train).collect()
    with pytest.raises(Exception, match="too few dates"):
        splits.calibration_split(train.where("feature_time < '2026-01-06'")).collect()


def test_ordered_numbers_with_one_key_and_one_value(spark):
    df = spark.range(200_000).select(F.lit("k").alias("key"), F.lit(7).alias("v"), F.col("id"))
    out = scale.row_numbers(df, ["key"], "v", ["id"], "n")
    assert out.where("n <> id + 1 OR n IS NULL").count() == 0
    parts = df.repartitionByRange(8, "key", "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 200_000 / 4


def test_codes_of_categories_with_a_common_prefix(spark):
    names = [f"SGN-{i:05d}" for i in range(5000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "c string")
    got = {r.category: r.code for r in splits.fit_category_codes(df, ["c"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted([*names, "__MISSING__"]))}


def test_weights_read_the_rows_twice(spark, tmp_path):
    rows = [(random.Random(i).randint(0, 1), f"r{i % 5}", f"t{i % 3}", 100_000 + i, 90_000) for i in range(300)]
    spark.createDataFrame(rows, "y int, route string, transition string, price_vnd long, target_price_vnd long").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for make in (splits.balanced_weights, splits.market_weights, splits.economic_weights):
        out = make(df, "y")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation \[[^\]]*price_vnd", plan)) == 1
        assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_isotonic_needs_support(spark):
    few = spark.range(100).select((F.col("id") % 2).alias("y"))
    rare = spark.range(400).select((F.col("id") < 20).cast("int").alias("y"))
    assert not calibration.isotonic_allowed(few, "y") and not calibration.isotonic_allowed(rare, "y")
    assert calibration.isotonic_allowed(spark.range(400).select((F.col("id") % 4 == 0).cast("int").alias("y")), "y")
