import datetime as dt
import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import calibration, history, market, metrics, pairs, quality, scale, serving


def panel3(spark):
    rows = [
        (C.TRIP_ERA, "SGN-HAN", "VN", 7, key, 1, "AM", dt.datetime(2026, 5, key, 9), price)
        for key, price in ((1, 1_000_000), (2, 1_100_000), (3, 1_200_000))
    ]
    schema = (
        "collection_era string, route string, airline string, days_until_departure int, session_key int, "
        "schedule_slot_id long, session_label string, feature_time timestamp_ntz, price_vnd long"
    )
    return spark.createDataFrame(rows, schema)


def test_history_is_strictly_prior(spark):
    out = history.schedule_history(panel3(spark), relative=False).orderBy("session_key").collect()
    assert [r.previous_price_same_schedule for r in out] == [None, 1_000_000, 1_100_000]
    assert [r.prior_observation_count for r in out] == [0, 1, 2]
    assert [r.prior_price_volatility_vnd for r in out] == [None, None, 50_000.0]
    assert [r.prior_price_trend_vnd_per_dud_day for r in out] == [None, None, None]


def test_market_anchor_shifts_one_batch(spark):
    out = market.market_anchor(panel3(spark)).orderBy("session_key").collect()
    assert [r.temporal_market_median_price for r in out] == [None, 1_000_000.0, 1_100_000.0]
    assert all(r.temporal_market_time < r.feature_time for r in out[1:])
    assert out[2].prior_market_change_pct_per_day == pytest.approx(10.0)


def test_perfect_classifier(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)], "y int, p double")
    row = metrics.classification_metrics(df, "y", "p").collect()[0]
    assert row.auc == 1.0 and row.brier < 1e-12 and row.log_loss < 1e-6


def test_point_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (400.0, 440.0)], "y double, q double")
    row = metrics.point_metrics(df, "y", "q").collect()[0]
    assert row.mae == pytest.approx(70 / 3)
    assert row.rmse == pytest.approx(math.sqrt(700))
    assert row.mape == pytest.approx(0.1)
    assert row.bias == pytest.approx(10)
    assert row.r2 == pytest.approx(0.955)


def test_distribution_metrics(spark):
    df = spark.createDataFrame([(10.0, [5.0, 6.0, 8.0, 9.0, 11.0, 13.0, 15.0])], "y double, q array<double>")
    row = metrics.distribution_metrics(df, "y", "q").collect()[0]
    assert (row.wis, row.width50, row.width80, row.width90) == pytest.approx((0.70, 3, 7, 10))


def test_ranking(spark):
    df = spark.createDataFrame([("q", 1, 100, 3), ("q", 2, 200, 2), ("q", 3, 300, 1)], "query_id string, offer_id long, price long, score long")
    row = metrics.ranking_metrics(df, "score", "price").collect()[0]
    assert (row.ndcg5, row.pairwise_concordance, row.queries) == (1.0, 1.0, 1)


def test_concordance_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"q{rng.choice((1, 1, 1, 2))}", i, rng.randint(1, 12), rng.randint(1, 9)) for i in range(90)]
    rows += [("same", 1000 + i, 5, i) for i in range(4)] + [("alone", 2000, 1, 1)]
    df = spark.createDataFrame(rows, "query_id string, offer_id long, price long, score long")
    got = {r.query_id: (r.informative_pairs, r.concordance) for r in metrics.concordance(df, "score", "price").collect()}
    for q in ("q1", "q2"):
        part = [r for r in rows if r[0] == q]
        good = total = 0
        for i, a in enumerate(part):
            for b in part[i + 1 :]:
                if a[2] != b[2]:
                    total += 1
                    good += np.sign(b[2] - a[2]) == np.sign(a[3] - b[3])
        assert got[q] == (total, pytest.approx(good / total))
    assert got["same"] == (0, 0.5)
    assert "alone" not in got
    strict = metrics.concordance(df, "score", "price", empty=None).collect()
    assert {r.query_id for r in strict} == {"q1", "q2"}


@pytest.mark.parametrize("values", [[4], [4, 9], [4, 4, 9], [1, 2, 2, 7], [5, 5, 5, 5, 5], [3, 1, 4, 1, 5, 9, 2]])
def test_leave_one_out_median(spark, values):
    rows = [(1, "r", dt.date(2026, 5, 1), i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "session_key int, route string, flight_date date, offer_id long, price_vnd long")
    for r in market.loo_median(df).collect():
        rest = [v for i, v in enumerate(values) if i != r.offer_id]
        assert r.peer_anchor_vnd == (median(rest) if rest else None)
        assert r.peer_anchor_support == len(rest)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    hot = [("hot", float(v)) for v in np.round(rng.normal(0, 3, 4000), 2)]
    rows = hot + [("small", v) for v in (-1.5, 0.0, 0.0, 2.0)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.995}
    got = {r.k: r for r in scale.exact_quantiles(df, ["k"], "v", probs, support="n").collect()}
    for key in ("hot", "small", "one"):
        values = [v for k, v in rows if k == key]
        assert got[key].n == len(values)
        for name, q in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), abs=1e-12)
    high = {r.k: r.h for r in scale.exact_quantiles(df, ["k"], "v", {"h": 0.9}, "higher").collect()}
    for key in ("hot", "small", "one"):
        assert high[key] == np.quantile([v for k, v in rows if k == key], 0.9, method="higher")


@pytest.mark.parametrize("spread", ["times", "ids", "skewed", "mixed"])
def test_buckets_are_monotone_and_even(spark, monkeypatch, spread):
    monkeypatch.setattr(scale, "BUCKET_VALUES", 500)
    monkeypatch.setattr(scale, "BUCKETS", 100)
    rng = np.random.default_rng(7)
    values = {
        "times": 1.7e9 + rng.uniform(-6 * 86400, 6 * 86400, 20_000), "ids": 9e12 + np.arange(20_000.0),
        "skewed": np.r_[rng.lognormal(0, 8, 10_000), -1e300, 1e300], "mixed": np.r_[rng.normal(0, 1e-6, 9000), rng.normal(1e9, 1, 9000), 0.0],
    }[spread]
    rows = [("large", float(v)) for v in np.unique(values)] + [("small", float(i)) for i in range(400)] + [(None, 1.0)]
    got = scale.equi_depth(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").orderBy("v").collect()
    large = [r["__bucket"] for r in got if r.k == "large"]
    assert large == sorted(large) and len(set(large)) > 90
    assert max(large.count(b) for b in set(large)) < 3 * len(large) / 100
    assert {r["__bucket"] for r in got if r.k != "large"} == {0}


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals_over_many_buckets(spark, monkeypatch, keys):
    monkeypatch.setattr(scale, "BUCKET_VALUES", 50)
    monkeypatch.setattr(scale, "BUCKETS", 40)
    rng = np.random.default_rng(8)
    rows = [("a" if keys else "x", float(v), int(n)) for v, n in zip(np.unique(1.7e9 + rng.uniform(-1e5, 1e5, 700)), rng.integers(1, 9, 700))] + [("b", float(i), 2) for i in range(30 if keys else 0)]
    got = scale.running_totals(spark.createDataFrame(rows, "k string, v double, n int"), keys, "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x for x in rows if not keys or x[0] == r.k]
        assert (r.n_before, r.n_total) == (sum(x[2] for x in same if x[1] < r.v), sum(x[2] for x in same))


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "i int, v int")
    got = {r.i: r.x for r in scale.with_rank(df, [], "v").select("i", scale.average_rank().alias("x")).collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


def test_row_numbers_on_a_hot_key(spark):
    rows = [(0, i * 7 % 100, i) for i in range(1000)] + [(1, 3, 5000)]
    df = spark.createDataFrame(rows, "q int, v int, id int")
    got = sorted((r.q, r.rn, r.id) for r in scale.row_numbers(df, ["q"], "v", ["id"], "rn").collect())
    want = [(0, n, r[2]) for n, r in enumerate(sorted((r for r in rows if r[0] == 0), key=lambda r: (r[1], r[2])), 1)]
    assert got == want + [(1, 1, 5000)]


def test_interpolation_between_windows(spark):
    rows = [("VN", 800, 5, 1_000_000.0, 0.20), ("VN", 800, 7, 1_200_000.0, 0.40), ("VJ", 900, 5, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "airline string, departure_hhmm int, days_until_departure int, price_vnd double, p_drop double")
    out = serving.interpolate_horizon(df, ["airline", "departure_hhmm"], ["price_vnd", "p_drop"], [6]).collect()
    assert len(out) == 1
    assert (out[0].price_vnd, out[0].p_drop, out[0].action) == (pytest.approx(1_100_000), pytest.approx(0.30), "WAIT")


def test_inference_row(spark):
    row = spark.createDataFrame(
        [(9, dt.date(2026, 8, 19), dt.date(2026, 9, 18), 30, 41_358, 5.0)],
        "offer_id long, session_date date, flight_date date, days_until_departure int, session_key int, target_price_vnd double",
    )
    out = pairs.next_window(row).collect()[0]
    assert (out.transition, out.expected_session_key) == ("30->21", 41_376)
    extra = row.withColumns({
        "historical_anchor_time": F.lit(None).cast("timestamp_ntz"), "feature_time": F.lit("2026-08-19 10:00:00").cast("timestamp_ntz"),
        "prior_relative_count": F.lit(0), "peer_anchor_support": F.lit(0), "route": F.lit("SGN-HAN"), "airline": F.lit("VN"),
    })
    assert not set(serving.LABEL_COLUMNS) & set(serving.inference_frame(extra, "2026-08-19").columns)


def test_unknown_era_fails(spark):
    df = spark.createDataFrame([(C.FLI_ERA,), ("UNKNOWN",)], "collection_era string")
    with pytest.raises(Exception, match="unknown collection era"):
        quality.normalise_eras(df).collect()


def test_checked_join_rejects_repeats_and_gaps(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats the join key"):
        quality.checked_join(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="does not cover"):
        quality.checked_join(left, right.where("v = 'a'"), ["k"], require_full=True).collect()


def test_asof_is_strict_on_equal_times(spark):
    t = [dt.datetime(2026, 5, d) for d in (1, 2, 3)]
    left = spark.createDataFrame([("a", t[0]), ("a", t[1]), ("a", t[2]), ("b", t[2])], "k string, lt timestamp_ntz")
    right = spark.createDataFrame([("a", t[0], 1.0), ("a", t[1], 2.0)], "k string, rt timestamp_ntz, v double")
    got = pairs.asof_strict(left, right, ["k"], "lt", "rt", ["v"]).orderBy("k", "lt").collect()
    assert [r.v for r in got] == [None, 1.0, 2.0, None]


def test_conformal_higher_offsets(spark):
    rows = [(float(y), [0.0] * 7) for y in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "y double, q array<double>")
    got = calibration.conformal_offsets(df, "y", "q").collect()[0].offsets
    assert got == [float(np.quantile([1, 2, 3, 4, 5], level, method="higher")) for level in C.QUANTILES]


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rows = [("A", dt.date(2026, 5, d), float(d % 5)) for d in range(1, 12)] + [("B", dt.date(2026, 6, d), float(d % 3)) for d in range(1, 12)]
    daily = spark.createDataFrame(rows, "block_id string, session_date date, delta double")
    a = metrics.block_bootstrap(daily, draws=500).collect()[0]
    b = metrics.block_bootstrap(daily.repartition(7), draws=500).collect()[0]
    assert a == b and a.ci95_low < a.mean_delta < a.ci95_high


def test_strict_union(spark):
    with pytest.raises(ValueError):
        quality.union_strict(spark.range(1), spark.range(1).toDF("x"))


def test_running_totals_make_their_histogram_once(spark, monkeypatch):
    monkeypatch.setattr(scale, "BUCKET_VALUES", 50)
    hist = scale.histogram(spark.range(500).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS v"), ["k"], "v")
    totals = scale.running_totals(hist, ["k"], "v", ["n"])
    assert "Range (0" not in totals._jdf.queryExecution().toString()
    assert all((r.n_before, r.n_total) == (r.v // 2, 250) for r in totals.collect())


def test_buckets_are_found_without_a_list_per_row(spark, monkeypatch):
    """a row compared itself with lists of 1,023 splitters in lambdas; the number is the count of splitters below."""
    seen, write = {}, scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda df, name: write(seen.setdefault(name, df), name))
    monkeypatch.setattr(scale, "BUCKET_VALUES", 50)
    rows = [("a", float(i)) for i in range(3000)] + [("b", float(i)) for i in range(5)]
    got = scale.equi_depth(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    buckets = [r["__bucket"] for r in sorted(got, key=lambda r: r.v) if r.k == "a"]
    assert buckets == sorted(buckets) and len(set(buckets)) > 1000 and buckets[0] == 0 and buckets[-1] == scale.BUCKETS - 1
    assert "lambda" not in seen["buckets"]._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, df, column):
    """The frame with a column that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(count, df.schema[column].dataType)(column)), made


def test_daily_agreement_makes_its_input_once(spark):
    """the match was made for the counts and again for the medians."""
    rows = [("d1", 1, 1, 1.00, 0.0), ("d1", 2, 1, 1.04, 4.0), ("d1", 1, 3, 1.08, 8.0), ("d2", 1, 1, 1.2, 20.0), ("d2", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "day string, a_rows long, b_rows long, ratio double, absolute_pct_difference double")
    matched, made = counted(spark, df, "day")
    got = {r.day: r.asDict() for r in serving.daily_agreement(matched, "day").collect()}
    assert got["d1"] == dict(day="d1", matched_slots=3, a_rows=4, b_rows=5, within_5pct=0.666666667, within_10pct=1.0, median_ratio=1.04)
    assert got["d2"] == dict(day="d2", matched_slots=2, a_rows=2, b_rows=2, within_5pct=0.0, within_10pct=0.0, median_ratio=1.2)
    assert made.value == len(rows)


def test_mondrian_offsets_make_their_head_once(spark):
    """the residuals of the head were made for the groups and again for all rows."""
    rows = [(g, float(i % 7), [i / 10.0 + j for j in range(7)]) for i, g in enumerate("ab" * 60)]
    head = spark.createDataFrame(rows, "g string, y double, q array<double>")
    valid, (head, made) = head, counted(spark, head, "g")
    calibration.conformal_mondrian(head, valid, "y", "q", "g", min_support=10).collect()
    assert made.value == len(rows)


def test_small_medians_are_exact(spark):
    """the median of one or two values needs no percentile; larger groups, nulls and null keys keep theirs."""
    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(t)) for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 8), (None, 5)) for v, t in zip(rng.normal(0, 1, n), range(n))]
    rows += [("e", None, 0), ("e", 2.0, 1), ("f", None, 3), ("g", None, 0), ("g", 1.0, 1), ("g", 4.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, t long")
    want = {r.k: (r.v, r.t) for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("v"), F.max("t").alias("t")).collect()}
    got = scale.small_medians(df, ["k"], ["v"], F.max("t").alias("t")).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.t == want[r.k][1]
        assert r.v == want[r.k][0] if want[r.k][0] is None else r.v == pytest.approx(want[r.k][0], abs=1e-15)


def test_quantile_recipes_are_scored_once(spark):
    """every recipe was scored for the table and again for the best one."""
    rows = [(g, float(i % 7), [i / 10.0 + j for j in range(7)]) for i, g in enumerate("ab" * 60)]
    head, made = counted(spark, spark.createDataFrame(rows, "g string, y double, q array<double>"), "g")
    got = calibration.choose_quantile_recipe(head, "y", "q", "g").collect()
    assert len(got) == 3 and sum(r.chosen for r in got) == 1
    assert made.value == 2 * len(rows)  # for the residuals and for the scores


def test_rearrange_names_its_array_twice_at_most(spark):
    """the array expression stood inside a lambda and was made again for every quantile."""
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([None, 3.0, None],), (None,)], "q array<double>").limit(1)
    out = df.select(K.rearrange(F.transform("q", lambda x: x + 1)).alias("z"))
    assert out.collect()[0].z == [2.0, 4.0, 4.0]
    twice = df.select(K.rearrange(K.rearrange(F.transform("q", lambda x: x + 1))).alias("z"))
    assert twice.collect()[0].z == [2.0, 4.0, 4.0]
    assert "sequence(" not in twice._jdf.queryExecution().logical().toString()
