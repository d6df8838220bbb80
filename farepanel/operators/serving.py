"""Serving: query identities, target-free frames, assembled predictions, interpolation and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.pairs import next_window
from farepanel.operators.scale import exact_quantiles, join_on, row_numbers, with_scalars
from farepanel.session import materialise

LABEL_COLUMNS = (
    "target_price_vnd", "label_time", "target_offer_id", "target_session_date", "target_session_key",
    "price_change_vnd", "price_change_pct", "drop_5pct",
)


def query_ids(df: DataFrame) -> DataFrame:
    clock = F.lpad(F.col("departure_hhmm").cast("string"), 4, "0")
    return df.withColumns(
        {
            "query_id": K.token("session_date", "session_label", "route", "flight_date"),
            "schedule_slot_key": K.token("route", "airline", "flight_date", clock),
            "schedule_template_id": K.token("route", "airline", clock),
        }
    )


def duplicate_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Nth repeat of a key in order.

    Repeats are first counted per distinct (key, order) value, so identical rows of a hot key are
    numbered from the counts and only rows that are fully equal share a task.
    """
    counts = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    inside = Window.partitionBy(*keys, *order).orderBy(*order)
    return (
        join_on(df, offsets, [*keys, *order], "left")
        .withColumn(name, (F.col("__o") + F.row_number().over(inside) - 1).cast("int"))
        .drop("__o")
    )


def with_bands(df: DataFrame) -> DataFrame:
    """Support, age and regime tags; a missing count is zero, a missing anchor time infinitely old."""
    age = K.hours_between("historical_anchor_time", "feature_time")
    count = F.coalesce("prior_relative_count", F.lit(0))
    return df.withColumns(
        {
            "history_support_band": K.right_closed_band(count, C.HISTORY_BANDS),
            "anchor_support_band": K.right_closed_band(F.coalesce("peer_anchor_support", F.lit(0)), C.PEER_SUPPORT_BANDS),
            "anchor_age_band": F.coalesce(K.right_closed_band(age, C.ANCHOR_AGE_BANDS), F.lit(C.ANCHOR_AGE_BANDS[0][-1])),
            "regime": F.when(count >= 3, "WARM").otherwise("COLD"),
            "market_group": K.market_group("route"),
            "route_airline": K.token("route", "airline"),
        }
    )


def inference_frame(df: DataFrame, date: str) -> DataFrame:
    """Current rows of one date with their next horizon and tags; label columns cannot pass."""
    current = df.where(F.col("session_date") == F.lit(date).cast("date")).drop(*LABEL_COLUMNS)
    frame = with_bands(next_window(current))
    return frame.withColumn("row_key", K.token("offer_id", "days_until_departure", "target_dud"))


def residual_to_price(df: DataFrame, train: DataFrame, anchor: str, residual: str, train_residual: str) -> DataFrame:
    """Anchor times exp(residual), the residual clipped to the central 99 percent of training."""
    edges = exact_quantiles(train, [], train_residual, {"lo": 0.005, "hi": 0.995})
    clipped = F.greatest(F.least(F.col(residual), F.col("hi")), F.col("lo"))
    return (
        with_scalars(df, edges)
        .withColumn("predicted_vnd", F.when(F.col(residual).isNotNull(), F.col(anchor) * F.exp(clipped)))
        .drop("lo", "hi")
    )


def assemble(features: DataFrame, parts: Mapping[str, DataFrame], actions: DataFrame, key: str = "row_key") -> DataFrame:
    """Features with one row of every task output; an absent action means BUY."""
    out = features
    for part in parts.values():
        out = out.join(part, key)
    return out.join(actions.select(key, "action"), key, "left").withColumn("action", F.coalesce("action", F.lit("BUY")))


def bracket(dud: int, windows: Sequence[int] = C.BOOKING_WINDOWS) -> tuple[int, int]:
    lower = max(w for w in windows if w <= dud)
    upper = min(w for w in windows if w >= dud)
    return lower, upper


def interpolate_horizon(
    snapshot: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    duds: Sequence[int],
    windows: Sequence[int] = C.BOOKING_WINDOWS,
    probability: str = "p_drop",
    threshold: float = C.WAIT_THRESHOLD,
) -> DataFrame:
    """Off-grid horizons by linear weights between the bracketing windows of the same template.

    The two bracket rows of each wanted horizon meet in one grouped aggregate; there is no self-join.
    """
    wanted = []
    for d in duds:
        lower, upper = bracket(d, windows)
        weight = 0.0 if lower == upper else (d - lower) / (upper - lower)
        wanted.append((d, lower, upper, weight))
    side = lambda d, w, t: F.struct(F.lit(d).alias("wanted_dud"), F.lit(w).alias("w"), F.lit(t).alias("upper"))
    chain = None
    for window in windows:
        uses = [side(d, 1.0 - wt, False) for d, lo, hi, wt in wanted if lo == window]
        uses += [side(d, wt, True) for d, lo, hi, wt in wanted if hi == window and lo != hi]
        if uses:
            hit = F.col("days_until_departure") == window
            chain = F.when(hit, F.array(*uses)) if chain is None else chain.when(hit, F.array(*uses))
    long = snapshot.withColumn("__use", F.explode(chain)).select("*", "__use.*").drop("__use")
    needed = {d: (1 if lo == hi else 2) for d, lo, hi, _ in wanted}
    grouped = long.groupBy(*keys, "wanted_dud").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(v) * F.col("w")).alias(v) for v in values]
    )
    complete = grouped.where(F.col("__n") == K.lookup("wanted_dud", needed)).drop("__n")
    return complete.withColumn("action", F.when(F.col(probability) >= threshold, "WAIT").otherwise("BUY"))


def ranked_offers(df: DataFrame, query: str = "query_id", price: str = "pred_vnd") -> DataFrame:
    """All rows of every query by price, then clock, airline and identity, with rank and cheapest flag.

    Rows of one query are spread by price; only equal prices meet in one task.
    """
    ties = ["departure_hhmm", "airline", "offer_id"]
    return row_numbers(df, [query], price, ties, "rank").withColumn("is_cheapest", F.col("rank") == 1)


def observed_query(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Latest observation per (airline, clock) of each asked (route, flight date)."""
    keys = ["route", "flight_date"]
    wanted = queries.select(*keys).distinct()
    latest = df.groupBy(*keys, "airline", "departure_hhmm").agg(
        F.max(F.struct("feature_time", "session_key", "offer_id", "price_vnd", "days_until_departure")).alias("x")
    )
    return latest.join(wanted, keys, "left_semi").select(*keys, "airline", "departure_hhmm", "x.*")


def prediction_catalog(df: DataFrame) -> DataFrame:
    """Airlines and offers per route."""
    pairs = df.groupBy("route", "airline").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("route").agg(
        F.array_join(F.sort_array(F.collect_set("airline")), ",").alias("airlines"),
        F.count(F.lit(1)).alias("airline_count"),
        F.sum("n").alias("offers"),
    )


def daily_agreement(matched: DataFrame, date: str) -> DataFrame:
    """Matched slots per day with the median ratio and the shares within five and ten percent.

    The matched rows are written once: the match behind them would be made again for the counts and for the medians.
    """
    difference = F.col("absolute_pct_difference")
    matched = materialise(matched.select(date, "a_rows", "b_rows", "ratio", difference), "matched")
    counts = matched.groupBy(date).agg(
        F.count(F.lit(1)).alias("matched_slots"),
        F.sum("a_rows").alias("a_rows"),
        F.sum("b_rows").alias("b_rows"),
        F.round(F.avg(F.when(difference <= 5, 1.0).otherwise(0.0)), 9).alias("within_5pct"),
        F.round(F.avg(F.when(difference <= 10, 1.0).otherwise(0.0)), 9).alias("within_10pct"),
    )
    median = exact_quantiles(matched, [date], "ratio", {"median_ratio": 0.5})
    return join_on(counts, median, [date]).withColumn("median_ratio", F.round("median_ratio", 9))
