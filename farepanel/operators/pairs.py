"""Pairs of an offer with its later observations, label states and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.scale import join_on

TARGET_COLUMNS = {
    "offer_id": "target_offer_id",
    "price_vnd": "target_price_vnd",
    "feature_time": "label_time",
    "session_date": "target_session_date",
    "session_key": "target_session_key",
    "collection_era": "target_collection_era",
}


def _targets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(
        *keys,
        F.col("days_until_departure").alias("target_dud"),
        *[F.col(a).alias(b) for a, b in TARGET_COLUMNS.items()],
    )


def next_window(df: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Next horizon on the grid with the expected label date and batch; terminal rows drop out."""
    gap = F.col("days_until_departure") - F.col("target_dud")
    return (
        df.withColumn("target_dud", K.next_dud("days_until_departure", windows))
        .where(F.col("target_dud").isNotNull())
        .withColumn("horizon_gap_days", gap)
        .withColumn("transition", K.transition("days_until_departure", "target_dud"))
        .withColumn("expected_label_date", F.date_sub(F.col("flight_date"), F.col("target_dud")))
        .withColumn("expected_session_key", F.col("session_key") + 2 * F.col("horizon_gap_days"))
    )


def exact_next_pairs(df: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS, targets: DataFrame | None = None) -> DataFrame:
    """Offer and the same slot and half-day at the next horizon, legal pairs only.

    A slot fixes route, airline, flight date and minute; they are still compared on the target side. ``targets`` may give
    the same offers in a form that is cheaper to read than ``df``.
    """
    same = ["route", "airline", "flight_date", "departure_minute"]
    target = (df if targets is None else targets).select(
        "schedule_slot_id",
        "session_label",
        F.col("days_until_departure").alias("target_dud"),
        *[F.col(a).alias(b) for a, b in TARGET_COLUMNS.items()],
        *[F.col(c).alias(f"__{c}") for c in same],
    )
    legal = (F.col("label_time") > F.col("feature_time")) & (
        F.col("target_session_date") == F.col("expected_label_date")
    )
    for c in same:
        legal = legal & (F.col(c) == F.col(f"__{c}"))
    pairs = next_window(df, windows).join(target, ["schedule_slot_id", "session_label", "target_dud"]).where(legal)
    change = F.col("target_price_vnd") - F.col("price_vnd")
    return (
        pairs.drop(*[f"__{c}" for c in same])
        .withColumn("current_dud", F.col("days_until_departure"))
        .withColumn("price_change_vnd", change)
        .withColumn("price_change_pct", F.lit(100.0) * change / F.col("price_vnd"))
        .withColumn("drop_5pct", K.drop_label("price_vnd", "target_price_vnd"))
        .withColumn("source_target_era_transition", K.transition("collection_era", "target_collection_era"))
        .withColumn(
            "bridge_label_stability",
            K.bridge_stability("collection_era", "target_collection_era", "price_vnd", "target_price_vnd"),
        )
    )


def multi_horizon_pairs(df: DataFrame, time: str = "feature_time") -> DataFrame:
    """Every later horizon of the same era, slot and half-day whose date is the expected one.

    The fan-out is the feature and is bounded by the horizon grid (at most ten targets per offer).
    """
    entity = ["collection_era", "schedule_slot_id", "session_label"]
    target = df.select(
        *entity,
        F.col("days_until_departure").alias("target_dud"),
        F.col("offer_id").alias("target_offer_id"),
        F.col("price_vnd").alias("target_price_vnd"),
        F.col(time).alias("label_time"),
        F.col("session_date").alias("target_session_date"),
    )
    return (
        df.join(target, entity)
        .where(
            (F.col("target_dud") < F.col("days_until_departure"))
            & (F.col("label_time") > F.col(time))
            & (F.col("target_session_date") == F.date_sub(F.col("flight_date"), F.col("target_dud")))
        )
        .withColumn("current_dud", F.col("days_until_departure"))
        .withColumn("horizon_gap_days", F.col("days_until_departure") - F.col("target_dud"))
        .withColumn("is_exact_next", F.coalesce(K.next_dud("days_until_departure") == F.col("target_dud"), F.lit(False)))
        .withColumn("price_change_vnd", F.col("target_price_vnd") - F.col("price_vnd"))
        .withColumn("price_change_pct", F.lit(100.0) * F.col("price_change_vnd") / F.col("price_vnd"))
    )


def dud1_intraday(df: DataFrame) -> DataFrame:
    """Last-day morning offer with the first later evening observation of the same slot and day."""
    keys = ["collection_era", "schedule_slot_id", "session_date"]
    last = df.where(F.col("days_until_departure") == 1)
    evening = (
        last.where(F.col("session_label") == "PM")
        .select(
            *keys,
            F.col("offer_id").alias("target_offer_id"),
            F.col("feature_time").alias("label_time"),
            F.col("price_vnd").alias("target_price_vnd"),
        )
    )
    later = last.where(F.col("session_label") == "AM").join(evening, keys).where(
        F.col("label_time") > F.col("feature_time")
    )
    first = F.row_number().over(Window.partitionBy("offer_id").orderBy("label_time", "target_offer_id"))
    return (
        later.withColumn("__r", first)
        .where("__r = 1")
        .drop("__r")
        .withColumn("horizon_gap_hours", K.hours_between("feature_time", "label_time"))
        .withColumn("will_drop_intraday", K.drop_label("price_vnd", "target_price_vnd"))
    )


def nearest_lower(exact: DataFrame, multi: DataFrame) -> DataFrame:
    """Offers without an exact label: nearest lower horizon, earliest label."""
    rest = multi.join(exact.select("offer_id"), "offer_id", "left_anti")
    order = Window.partitionBy("offer_id").orderBy(F.col("target_dud").desc(), "label_time", "target_offer_id")
    return rest.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def asof_strict(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]
) -> DataFrame:
    """Latest right row strictly before each left time.

    The as-of search runs on the distinct (key, time) points of both sides, not on the rows, so a hot
    key costs at most its number of distinct times; on equal times the left point sorts first.
    """
    points = left.select(*by, F.col(left_time).alias("__t")).distinct()
    marks = right.groupBy(*by, F.col(right_time).alias("__t")).agg(
        F.max(F.struct(*values)).alias("__v")
    )
    events = points.select(*by, "__t", F.lit(0).alias("__s"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v")).unionByName(
        marks.select(*by, "__t", F.lit(1).alias("__s"), "__v")
    )
    w = Window.partitionBy(*by).orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("__v", F.last("__v", True).over(w)).where("__s = 0")
    found = found.select(*by, F.col("__t").alias(left_time), *[F.col(f"__v.{v}").alias(v) for v in values])
    return join_on(left, found, [*by, left_time], "left")


def target_market(pairs: DataFrame, offers: DataFrame) -> DataFrame:
    """Latest market median of the target horizon known strictly before the feature time."""
    by = ["collection_era", "route", "airline", "target_dud"]
    market = offers.groupBy(
        "collection_era", "route", "airline", F.col("days_until_departure").alias("target_dud"),
        F.col("feature_time").alias("market_time"),
    ).agg(F.median("price_vnd").alias("causal_target_market_median"))
    return asof_strict(pairs, market, by, "feature_time", "market_time", ["causal_target_market_median"])


def observability(df: DataFrame, cutoff: str, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Every source offer with its expected target: censored, observed or missing."""
    target = df.select(
        "schedule_slot_id",
        "session_label",
        F.col("days_until_departure").alias("target_dud"),
        F.col("offer_id").alias("observed_target_offer_id"),
        F.col("feature_time").alias("observed_label_time"),
    )
    out = next_window(df, windows).join(target, ["schedule_slot_id", "session_label", "target_dud"], "left")
    mature = F.col("expected_label_date") <= F.lit(cutoff).cast("date")
    return out.withColumn(
        "target_observation_state",
        F.when(~mature, "IMMATURE_RIGHT_CENSORED")
        .when(F.col("observed_target_offer_id").isNotNull(), "OBSERVED")
        .otherwise("MATURE_NOT_OBSERVED"),
    ).withColumn("metric_eligible", F.col("target_observation_state") == "OBSERVED")


def attach_events(pairs: DataFrame, definitions: dict, prefix: str = "event_") -> DataFrame:
    """All drop definitions of a table as flags."""
    return pairs.withColumns(
        {
            f"{prefix}{name}": K.event_label("price_vnd", "target_price_vnd", kind, fraction, amount)
            for name, (kind, fraction, amount) in definitions.items()
        }
    )


def event_truth(offers: DataFrame, pairs: DataFrame, source: str) -> DataFrame:
    """Offers joined to label pairs, with the horizon excess over the grid step and every drop flag."""
    event = pairs.select(
        "offer_id", "target_offer_id", "current_dud", "target_dud", "horizon_gap_days",
        "label_time", "target_price_vnd", "price_change_vnd", "price_change_pct",
    )
    expected = F.col("current_dud") - K.next_dud("current_dud")
    frame = (
        event.join(offers, "offer_id")
        .withColumn("transition", K.transition("current_dud", "target_dud"))
        .withColumn("event_source", F.lit(source))
        .withColumn("is_auxiliary_target", F.lit(int(source == "AUX_NEAREST_LOWER")))
        .withColumn("aux_gap_extra_days", F.greatest(F.col("horizon_gap_days") - expected, F.lit(0)))
        .withColumn("saving_vnd", F.col("price_vnd") - F.col("target_price_vnd"))
    )
    future = F.when(F.col("label_time") > F.col("feature_time"), F.col("label_time")).otherwise(
        F.raise_error(F.lit("event label is not in the future")).cast("timestamp_ntz")
    )
    return attach_events(frame.withColumn("label_time", future), C.EVENT_DEFINITIONS_MIN)


def dud1_events(offers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Last-day intraday events, morning sources only."""
    event = pairs.select("offer_id", "target_offer_id", "label_time", "target_price_vnd", "horizon_gap_hours")
    frame = (
        _in_time_order(event.join(offers, "offer_id"), "label_time", "intraday")
        .withColumn("horizon_gap_days", F.lit(0))
        .withColumn("is_auxiliary_target", F.lit(0))
        .withColumn("aux_gap_extra_days", F.lit(0))
        .withColumn("transition", F.lit("DUD1_AM->PM"))
        .withColumn("event_source", F.lit("DUD1_INTRADAY_AM_TO_PM"))
        .withColumn("saving_vnd", F.col("price_vnd") - F.col("target_price_vnd"))
        .withColumn(
            "session_label",
            F.when(F.col("session_label") == "AM", F.col("session_label")).otherwise(
                F.raise_error(F.lit("intraday source is not a morning offer"))
            ),
        )
    )
    return attach_events(frame, C.EVENT_DEFINITIONS_MIN)


def event_registry(offers: DataFrame, exact: DataFrame, aux: DataFrame, dud1: DataFrame, cutoff: str) -> DataFrame:
    """Label status of every offer; the three label sets arrive as one flag table."""
    flags = (
        exact.select("offer_id", F.lit(1).alias("e"), F.lit(0).alias("a"), F.lit(0).alias("d"))
        .unionByName(aux.select("offer_id", F.lit(0).alias("e"), F.lit(1).alias("a"), F.lit(0).alias("d")))
        .unionByName(dud1.select("offer_id", F.lit(0).alias("e"), F.lit(0).alias("a"), F.lit(1).alias("d")))
        .groupBy("offer_id")
        .agg(F.max("e").alias("e"), F.max("a").alias("a"), F.max("d").alias("d"))
    )
    base = offers.join(flags, "offer_id", "left").withColumns(
        {
            "has_exact_label": F.coalesce("e", F.lit(0)),
            "has_aux_nearest_lower_label": F.coalesce("a", F.lit(0)),
            "has_dud1_intraday_label": F.coalesce("d", F.lit(0)),
            "expected_target_dud": K.next_dud("days_until_departure"),
        }
    ).drop("e", "a", "d")
    base = base.withColumn("expected_label_date", F.date_sub("flight_date", F.col("expected_target_dud")))
    exact_hit, last_day = F.col("has_exact_label") == 1, F.col("days_until_departure") == 1
    morning = F.col("session_label") == "AM"
    censored = F.coalesce(F.col("expected_label_date") > F.lit(cutoff).cast("date"), F.lit(False))
    exact_status = (
        F.when(exact_hit, "EXACT_MATURE")
        .when(last_day, "NOT_APPLICABLE_DUD1")
        .when(censored, "RIGHT_CENSORED")
        .otherwise("MATURED_NOT_REOBSERVED")
    )
    status = (
        F.when(exact_hit, "EXACT_MATURE")
        .when(last_day & morning & (F.col("has_dud1_intraday_label") == 1), "DUD1_INTRADAY_MATURE")
        .when(last_day & morning, "DUD1_INTRADAY_MISSING")
        .when(last_day, "DUD1_PM_TERMINAL")
        .when(F.col("has_aux_nearest_lower_label") == 1, "AUX_NEAREST_AVAILABLE")
        .when(censored, "RIGHT_CENSORED")
        .otherwise("MATURED_NOT_REOBSERVED")
    )
    return base.withColumn("exact_status", exact_status).withColumn("event_label_status", status)


def _in_time_order(df: DataFrame, outcome: str, what: str) -> DataFrame:
    """The outcome time, or a failure where it is not after the feature time."""
    late = F.raise_error(F.lit(f"{what} outcome is not after its feature time")).cast("timestamp_ntz")
    return df.withColumn(outcome, F.when(F.col("feature_time") >= F.col(outcome), late).otherwise(F.col(outcome)))


def reobservation(offers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mature ledger rows with the re-observed flag; the outcome is known the day after the target day."""
    mature = ledger.where(F.col("target_observation_state") != "IMMATURE_RIGHT_CENSORED").select(
        "offer_id",
        "target_dud",
        "horizon_gap_days",
        (F.col("target_observation_state") == "OBSERVED").cast("int").alias("reobserved"),
        F.date_add("expected_label_date", 1).cast("timestamp_ntz").alias("outcome_time"),
    )
    return _in_time_order(mature.join(offers, "offer_id", "left"), "outcome_time", "reobservation")


def event_frame(offers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact pairs with the enriched columns of their offer, closing drop labels and time order."""
    extra = [c for c in offers.columns if c not in pairs.columns]
    frame = pairs.join(offers.select("offer_id", *extra), "offer_id", "left").withColumn(
        "outcome_time", F.col("label_time")
    )
    required = ["feature_time", "outcome_time", "price_vnd", "target_price_vnd", "route", "airline", "transition"]
    complete = _in_time_order(frame.na.drop(subset=required), "outcome_time", "event")
    return attach_events(complete, C.EVENT_DEFINITIONS_MAX)


def cross_source(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest fare per slot key in two sources and their ratio."""
    left = a.groupBy(*keys).agg(F.min("price_vnd").alias("a_price_vnd"), F.count(F.lit(1)).alias("a_rows"))
    right = b.groupBy(*keys).agg(F.min("price_vnd").alias("b_price_vnd"), F.count(F.lit(1)).alias("b_rows"))
    ratio = F.col("b_price_vnd") / F.col("a_price_vnd")
    return (
        left.join(right, list(keys))
        .withColumn("ratio", ratio)
        .withColumn("absolute_pct_difference", F.lit(100.0) * F.abs(ratio - 1))
    )


def choice_set(df: DataFrame, minutes: int = 60) -> DataFrame:
    """Number and lowest fare of other departures of a query within a time distance.

    A query is reduced to one row per departure minute (at most 1,440), each minute's statistics are
    read through a range frame, and the offer itself is taken out with counts and the two lowest fares.
    """
    keys = ["session_key", "route", "flight_date"]
    per_minute = df.groupBy(*keys, "departure_minute").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("price_vnd", "offer_id")).alias("low")
    )
    w = Window.partitionBy(*keys).orderBy("departure_minute")
    near = w.rangeBetween(-minutes, minutes)
    before, after = w.rangeBetween(-minutes, -1), w.rangeBetween(1, minutes)
    stats = per_minute.select(
        *keys,
        "departure_minute",
        F.sum("n").over(near).alias("__n"),
        F.least(F.min("low.price_vnd").over(before), F.min("low.price_vnd").over(after)).alias("__others"),
    )
    # Within the same minute only the two lowest fares can be the answer.
    rank = F.row_number().over(Window.partitionBy(*keys, "departure_minute").orderBy("price_vnd", "offer_id"))
    two = (
        df.select(*keys, "departure_minute", "price_vnd", "offer_id")
        .withColumn("r", rank)
        .where("r <= 2")
        .groupBy(*keys, "departure_minute")
        .agg(
            F.max(F.when(F.col("r") == 1, F.col("offer_id"))).alias("__first"),
            F.max(F.when(F.col("r") == 1, F.col("price_vnd"))).alias("__m1"),
            F.max(F.when(F.col("r") == 2, F.col("price_vnd"))).alias("__m2"),
        )
    )
    out = join_on(df, join_on(stats, two, [*keys, "departure_minute"]), [*keys, "departure_minute"], "left")
    same = F.when(F.col("offer_id") == F.col("__first"), F.col("__m2")).otherwise(F.col("__m1"))
    return (
        out.withColumn("alternatives", F.col("__n") - 1)
        .withColumn("alternative_min_price", F.least(F.col("__others"), same))
        .drop("__n", "__others", "__first", "__m1", "__m2")
    )
