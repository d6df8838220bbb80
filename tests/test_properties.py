"""Leaks, row order, plans and parity of streaming with batch."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from farepanel.operators import history, market, metrics
from farepanel.session import local_session
from farepanel.sources import files
from farepanel.streaming import ingest, state
from tests.conftest import SF

FEATURES = ["previous_price_same_schedule", "prior_price_volatility_vnd", "prior_price_trend_vnd_per_dud_day"]


def features(df):
    out = history.schedule_history(market.market_anchor(market.batch_feature_time(df)), relative=False)
    return {r.offer_id: tuple(r)[1:] for r in out.select("offer_id", *FEATURES, "temporal_market_median_price").collect()}


def test_future_prices_never_change_earlier_features(panel):
    cut = F.lit("2026-04-25").cast("date")
    changed = panel.offers.withColumn("price_vnd", F.when(F.col("session_date") >= cut, F.col("price_vnd") * 3).otherwise(F.col("price_vnd")))
    early = {r.offer_id for r in panel.offers.where(F.col("session_date") < cut).select("offer_id").collect()}
    a, b = features(panel.offers), features(changed)
    assert all(a[i] == b[i] for i in early)
    assert any(a[i] != b[i] for i in a)


def test_row_order_does_not_matter(panel):
    assert features(panel.offers) == features(panel.offers.orderBy(F.rand(5)))


def test_history_rows_are_prior(panel):
    row = entry.queries()["pit_violations"](panel.spark, SF).collect()[0]
    assert row.history_not_prior == row.market_not_prior == row.same_batch_history == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["exact_next_pairs", "multi_horizon_pairs", "loo_median", "choice_set", "asof_target_market", "topk_ranked_offers", "roc_auc", "point_metrics"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan_of(entry.queries()[name](spark, SF))


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(entry.queries()["scan_projected"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan or "o_comment" not in plan


def test_rank_filter_runs_before_the_shuffle(spark, panel):
    from farepanel.operators.selection import topk_per_group

    assert "WindowGroupLimit" in plan_of(topk_per_group(panel.offers, ["route"], ["price_vnd", "offer_id"], 2))


def test_daily_files_with_bom_and_cutoff(spark, tmp_path):
    header = "﻿" + ",".join(files.OFFER_FIELDS)
    line = "2026-05-01 08:00:00,2026-05-01 08:00:00,SGN,HAN,SGN-HAN,7,2026-05-08,VN,V,123.0,2026-05-08 10:00:00,40,1000000"
    for day in ("2026-05-01", "2026-05-02", "2026-06-09"):
        (tmp_path / f"{day}.csv").write_text(header + "\n" + line + "\n", encoding="utf-8")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    df = files.scan_daily(spark, str(tmp_path), "2026-05-31", "FLI_LIBRARY_ERA", "fli_library")
    rows = df.orderBy("file_date").collect()
    assert [str(r.file_date) for r in rows] == ["2026-05-01", "2026-05-02"]
    assert rows[0].scraped_at == "2026-05-01 08:00:00" and rows[0].price_vnd == "1000000"
    assert files.file_date_violations(df).count() == 1


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("2026-05-01", 1), ("2026-05-02", 2)], "session_date string, v int")
    files.write_partitioned(df, path)
    files.write_partitioned(df.where("v = 2").withColumn("v", F.lit(9)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


@pytest.mark.parametrize("cuts", [1, 5])
def test_stream_history_for_any_micro_batches(spark, panel, tmp_path, cuts):
    keep = ["schedule_slot_id", "offer_id", "feature_time", "session_key", "price_vnd", "days_until_departure", "departure_time"]
    df = panel.timed.select(*keep)
    keys = [r[0] for r in df.select("session_key").distinct().orderBy("session_key").collect()]
    bounds = [keys[len(keys) * i // cuts] for i in range(cuts)] + [keys[-1] + 1]
    path = str(tmp_path / "in")
    for a, b in zip(bounds, bounds[1:]):
        df.where((F.col("session_key") >= a) & (F.col("session_key") < b)).coalesce(1).write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    stream = ingest.read_offers(spark, path, df.schema, 1)
    with state.on_rocksdb(spark):
        ingest.run(state.stateful_history(stream), str(tmp_path / "cp"), ingest.changelog_writer(out))
    got = spark.read.parquet(out)
    want = history.schedule_history(panel.timed, by_era=False, relative=False)
    both = got.alias("g").join(want.alias("w"), "offer_id")
    bad = both.where(
        (F.col("g.prior_observation_count") != F.col("w.prior_observation_count"))
        | ~F.col("g.previous_price_same_schedule").eqNullSafe(F.col("w.previous_price_same_schedule").cast("double"))
        | (F.abs(F.col("g.prior_price_volatility_vnd") - F.col("w.prior_price_volatility_vnd")) > 1e-3)
    )
    assert got.count() == want.count() and bad.count() == 0


def test_a_hot_query_gives_the_same_ranking_scores(spark):
    rng = random.Random(11)
    rows = [("hot", i, rng.randint(1, 400), rng.randint(1, 300)) for i in range(600)] + [(f"q{i % 40}", 1000 + i, rng.randint(1, 9), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, offer_id long, price long, score long")
    got = {r.query_id: r.concordance for r in metrics.concordance(df, "score", "price").collect()}
    part = [r for r in rows if r[0] == "hot"]
    pairs = [(a, b) for i, a in enumerate(part) for b in part[i + 1 :] if a[2] != b[2]]
    good = sum((a[2] < b[2]) == (a[3] > b[3]) and a[3] != b[3] for a, b in pairs)
    assert got["hot"] == pytest.approx(good / len(pairs))


def test_local_session_is_reused():
    assert local_session("8", "tests", "4g") is not None
