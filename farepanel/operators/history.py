"""Strictly prior statistics.

A slot appears once per batch after ``completed_batch_offers``, so a slot window holds at most one row
per batch of the calendar; template and market windows run on batch aggregates for the same reason.
All statistics of one entity share one window specification: one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.scale import exact_quantiles, join_on, small_medians, with_scalars


def schedule_history(df: DataFrame, by_era: bool = True, relative: bool = True) -> DataFrame:
    """Prior count, last state, volatility and trend per slot; also on the anchor-relative log."""
    keys = ["collection_era", "schedule_slot_id"] if by_era else ["schedule_slot_id"]
    w = Window.partitionBy(*keys).orderBy("feature_time", "session_key")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    price, dud = F.col("price_vnd").cast("double"), F.col("days_until_departure").cast("double")
    count = F.row_number().over(w) - 1
    columns = {
        "prior_observation_count": count,
        "previous_price_same_schedule": F.lag("price_vnd").over(w),
        "previous_schedule_time": F.lag("feature_time").over(w),
        "previous_schedule_session_key": F.lag("session_key").over(w),
        "previous_schedule_session_label": F.lag("session_label").over(w),
        "previous_schedule_collection_era": F.lag("collection_era").over(w),
        "prior_price_volatility_vnd": F.when(count >= 2, F.stddev_pop(price).over(prior)),
        "prior_price_trend_vnd_per_dud_day": F.when(count >= 2, F.regr_slope(price, dud).over(prior)),
    }
    if relative:
        z = F.col("current_relative_log")
        seen = F.coalesce(F.count(z).over(prior), F.lit(0))
        columns |= {
            "prior_relative_count": seen,
            "previous_relative_log": F.lag("current_relative_log").over(w),
            "previous_anchor_vnd": F.lag("anchor_vnd").over(w),
            "prior_relative_volatility": F.when(seen >= 2, F.stddev_pop(z).over(prior)),
            "prior_relative_trend_per_dud_day": F.when(seen >= 2, F.regr_slope(z, dud).over(prior)),
            "relative_history_eligible": (seen >= 3).cast("int"),
        }
    out = df.withColumns(columns)
    out = out.withColumn("lag_age_hours", K.hours_between("previous_schedule_time", "feature_time")).withColumn(
        "has_same_schedule_history", F.col("previous_price_same_schedule").isNotNull().cast("int")
    )
    if relative:
        out = out.withColumn("market_shift_log", K.safe_log("anchor_vnd") - K.safe_log("previous_anchor_vnd"))
    return out


def template_history(df: DataFrame, keys: Sequence[str] = ("route", "airline", "departure_minute")) -> DataFrame:
    """Prior batch statistics of a schedule template across flight dates, one row per (template, batch)."""
    b = df.groupBy(*keys, "session_key").agg(
        F.percentile("current_relative_log", 0.5).alias("z"),
        F.count(F.lit(1)).alias("rows"),
        F.max("feature_time").alias("t"),
        F.percentile("days_until_departure", 0.5).alias("x"),
    )
    w = Window.partitionBy(*keys).orderBy("t", "session_key")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    batches = F.row_number().over(w) - 1
    return b.select(
        *keys,
        "session_key",
        F.lag("z").over(w).alias("template_previous_relative_log"),
        F.lag("t").over(w).alias("template_previous_time"),
        F.coalesce(F.sum("rows").over(prior), F.lit(0)).alias("template_history_support_count"),
        F.when(batches >= 2, F.stddev_pop("z").over(prior)).alias("template_prior_relative_volatility"),
        F.when(batches >= 2, F.regr_slope("z", "x").over(prior)).alias("template_prior_relative_trend_per_dud_day"),
    )


def sequence_gaps(lane: DataFrame, keys: Sequence[str], time: str = "event_time") -> DataFrame:
    """Prior event count and gap in hours for each event of a lane."""
    w = Window.partitionBy(*keys).orderBy(time, "session_key")
    return lane.withColumn("prior_events", F.row_number().over(w) - 1).withColumn(
        "gap_hours", K.hours_between(F.lag(time).over(w), time)
    )


def sequence_summary(gaps: DataFrame, lengths: Sequence[int] = (7, 14, 21)) -> DataFrame:
    """Eligibility at several history lengths and quantiles of the positive gaps of a lane."""
    gap = F.col("gap_hours")
    counts = gaps.agg(
        F.count(F.lit(1)).alias("events"),
        *[
            (F.count_if(F.col("prior_events") >= n) * F.lit(100.0) / F.count(F.lit(1))).alias(f"eligible_{n}_pct")
            for n in lengths
        ],
        F.count_if(gap > 0).alias("positive_gaps"),
        F.count_if(gap <= 0).alias("nonpositive_gaps"),
        F.max(F.when(gap > 0, gap)).alias("max_gap_hours"),
    )
    probs = {"gap_p50": 0.5, "gap_p90": 0.9, "gap_p95": 0.95}
    return with_scalars(counts, exact_quantiles(gaps.where(gap > 0), [], "gap_hours", probs))


def sequence_source(df: DataFrame, kind: str = "TEMPLATE_DUD7") -> DataFrame:
    """One six-feature state per (group, batch): a slot, or a template within a week of horizon.

    A group holds few rows of one batch, so the medians are small; the gap runs over batches.
    """
    weekly = K.token("route", "airline", "departure_minute", F.floor(F.col("days_until_departure") / 7))
    group = F.col("schedule_slot_id").cast("string") if kind == "EXACT" else weekly
    one = F.lit(1.0)
    price = F.greatest(F.col("price_vnd").cast("double"), one)
    market = F.when(F.col("temporal_market_median_price").isNotNull(), F.greatest(F.col("temporal_market_median_price"), one))
    anchor = F.when(F.col("anchor_vnd").isNotNull(), F.greatest(F.col("anchor_vnd"), one))
    raw = {
        "f_relative_log": F.ln(price / F.coalesce(market, anchor, price)),
        "f_log_price": F.ln(price),
        "f_dud": F.least(F.greatest(F.col("days_until_departure"), F.lit(0)), F.lit(60)) / F.lit(60.0),
        "f_support_log": F.log1p(F.coalesce(F.col("temporal_market_support"), F.lit(0)).cast("double")),
        "f_batch_log": F.log1p(F.coalesce(F.col("batch_offer_count"), F.lit(0)).cast("double")),
    }
    rows = df.select(group.alias("group"), "session_key", "feature_time", *[e.alias(c) for c, e in raw.items()])
    b = small_medians(rows, ["group", "session_key"], list(raw), F.max("feature_time").alias("event_time"))
    w = Window.partitionBy("group").orderBy("event_time", "session_key")
    gap = F.coalesce(K.hours_between(F.lag("event_time").over(w), "event_time"), F.lit(0.0))
    clipped = F.least(F.greatest(gap, F.lit(0.0)), F.lit(C.SEQUENCE_GAP_CLIP_HOURS))
    return b.withColumn("f_gap_log", F.log1p(clipped))


STATE_FEATURES = ("f_relative_log", "f_log_price", "f_dud", "f_support_log", "f_batch_log", "f_gap_log")


def history_arrays(
    queries: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    length: int = C.SEQUENCE_LENGTH,
    inclusive: bool = False,
    cutoff: str = "feature_time",
    target_batch: str = "session_key",
) -> DataFrame:
    """Last ``length`` states before a cutoff as a padded array with mask and true length.

    Each source state first carries its own bounded trailing list (one extra state stands in for an
    excluded target batch), then queries take the list of their latest admissible state. Both sides are
    one row per (group, batch), so nothing larger than ``length + 1`` states is ever collected.
    """
    w = Window.partitionBy(*keys).orderBy("event_time", "session_key")
    state = F.struct(F.col("session_key").alias("batch"), F.array(*STATE_FEATURES).alias("x"))
    trail = source.select(
        *keys, F.col("event_time").alias("__t"), F.collect_list(state).over(w.rowsBetween(-length, 0)).alias("__states")
    )
    points = queries.select(*keys, cutoff, target_batch).distinct()
    side = F.lit(0 if inclusive else 1)
    events = trail.select(*keys, "__t", side.alias("__side"), "__states", F.lit(None).cast("int").alias("__b")).unionByName(
        points.select(
            *keys,
            F.col(cutoff).alias("__t"),
            (1 - side).alias("__side"),
            F.lit(None).cast(trail.schema["__states"].dataType).alias("__states"),
            F.col(target_batch).cast("int").alias("__b"),
        )
    )
    asof = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("__states", F.last("__states", True).over(asof)).where(F.col("__b").isNotNull())
    kept = F.filter(F.coalesce("__states", F.array()), lambda s: s["batch"] != F.col("__b"))
    found = found.withColumn("__states", kept)
    size = F.size("__states")
    tail = F.slice("__states", F.greatest(size - length + 1, F.lit(1)), F.lit(length))
    found = found.withColumn("__states", tail).withColumn("length", F.size("__states"))
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * len(STATE_FEATURES)), length - F.col("length"))
    arrays = found.select(
        *keys,
        F.col("__t").alias(cutoff),
        F.col("__b").alias(target_batch),
        F.concat(F.transform("__states", lambda s: s["x"]), pad).alias("history"),
        F.concat(
            F.array_repeat(F.lit(True), F.col("length")), F.array_repeat(F.lit(False), length - F.col("length"))
        ).alias("mask"),
        "length",
    )
    return join_on(queries, arrays, [*keys, cutoff, target_batch], "left")


def rolling_median(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), days: int = 7, min_obs: int = 3, centred: bool = False
) -> DataFrame:
    """Exact rolling median over a daily spine, null below ``min_obs`` observed days."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(date)
    half = days // 2
    frame = w.rowsBetween(-half, half) if centred else w.rowsBetween(-(days - 1), 0)
    return df.withColumn(
        f"{value}_smooth",
        F.when(F.count(value).over(frame) >= min_obs, F.percentile(value, F.lit(0.5)).over(frame)),
    )
