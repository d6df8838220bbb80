import datetime as dt

import pytest
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "text,label,date,daypart",
    [
        ("2026-05-02 05:59:59", "PM", dt.date(2026, 5, 1), "AM"),
        ("2026-05-02 06:00:00", "AM", dt.date(2026, 5, 2), "AM"),
        ("2026-05-02 17:59:59", "AM", dt.date(2026, 5, 2), "PM"),
        ("2026-05-02 18:00:00", "PM", dt.date(2026, 5, 2), "PM"),
        ("2026-05-03 01:00:00", "PM", dt.date(2026, 5, 2), "AM"),
    ],
)
def test_session_edges(spark, text, label, date, daypart):
    ts = F.lit(text).cast("timestamp_ntz")
    assert one(spark, K.session_label(ts)) == label
    assert one(spark, K.session_date(ts)) == date
    assert one(spark, K.ui_daypart(ts)) == daypart


def test_null_session_stays_null(spark):
    assert one(spark, K.session_label(F.lit(None).cast("timestamp_ntz"))) is None


@pytest.mark.parametrize("spec", [C.DUD_BUCKETS, C.DEPARTURE_PERIODS, C.HISTORY_BANDS, C.ANCHOR_AGE_BANDS, C.SESSION_GAP_BANDS])
def test_bands_are_right_closed(spark, spec):
    labels, edges = spec
    for edge, at, above in zip(edges, labels, labels[1:]):
        assert one(spark, K.right_closed_band(F.lit(edge), spec)) == at
        assert one(spark, K.right_closed_band(F.lit(edge + 0.5), spec)) == above
    assert one(spark, K.right_closed_band(F.lit(None).cast("int"), spec)) is None


def test_price_tiers(spark):
    tier = lambda price, route: one(spark, K.price_tier(F.lit(price).cast("bigint"), F.lit(route)))
    assert tier(None, "SGN-HAN") == "soldout"
    assert tier(100, "AAA-BBB") == "unknown"
    assert tier(5_000_000, "SGN-HAN") == "standard"
    assert tier(5_000_001, "SGN-HAN") == "high"
    assert tier(10_000_001, "SGN-HAN") == "extreme"


def test_event_boundaries(spark):
    label = lambda target, *d: one(spark, K.event_label(F.lit(1_000_000), F.lit(target), *d))
    assert label(950_000, "PCT", 0.05, 0) == 1
    assert label(950_001, "PCT", 0.05, 0) == 0
    assert label(1_000_000, "PCT", 0.0, 0) == 0
    assert label(999_999, "PCT", 0.0, 0) == 1
    assert label(950_000, "VND", 0.0, 50_000) == 1
    assert label(960_000, "MIN", 0.05, 40_000) == 1
    assert label(960_000, "MAX", 0.05, 40_000) == 0


def test_logs_guard_nulls_and_signs(spark):
    null = F.lit(None).cast("double")
    assert one(spark, K.safe_log(F.lit(0.0))) is None
    assert one(spark, K.safe_log1p(F.lit(-3.0))) == 0.0
    assert one(spark, K.safe_log1p(null)) is None
    assert one(spark, K.safe_log_ratio(null, F.lit(2.0))) is None
    assert one(spark, K.policy_regret(null, F.lit(1.0), F.lit(True), 0)) is None


def test_quantile_row_functions(spark):
    array = F.array(*[F.lit(float(v)) for v in (7, 6, 5, 4, 3, 2, 1)])
    assert one(spark, K.rearrange(array)) == [7.0] * 7
    assert one(spark, K.crossing(array)) == 1
    hand = F.array(*[F.lit(float(v)) for v in (5, 6, 8, 9, 11, 13, 15)])
    assert one(spark, K.pinball_mean(F.lit(10.0), hand)) == pytest.approx(0.35)
    assert one(spark, K.wis(F.lit(10.0), hand)) == pytest.approx(0.70)


def test_flight_numbers(spark):
    args = lambda no: (F.lit(no), F.lit("VN"), F.lit(800))
    assert one(spark, K.verified_flight_no(*args(" 123.0"))) == "VN123"
    assert one(spark, K.schedule_fallback(*args("vn-0800"))) is True
    assert one(spark, K.verified_flight_no(*args("VN-0800"))) is None
