"""Market context: batch times, market anchors, peer medians and backoff anchors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.backoff import first_supported_quantiles
from farepanel.operators.scale import histogram, join_on

MARKET_KEYS = ("route", "airline", "days_until_departure")

ANCHOR_LEVELS = {
    "ROUTE_AIRLINE_PERIOD_DUD": ("route", "airline", "departure_period", "days_until_departure"),
    "ROUTE_AIRLINE_DUD": ("route", "airline", "days_until_departure"),
    "ROUTE_DUD": ("route", "days_until_departure"),
    "AIRLINE_DUD": ("airline", "days_until_departure"),
    "GLOBAL_DUD": ("days_until_departure",),
    "GLOBAL_BATCH": (),
}
LEGACY_LEVELS = {
    "ROUTE_AIRLINE_DUD": ("route", "airline", "days_until_departure"),
    "ROUTE_DUD": ("route", "days_until_departure"),
    "AIRLINE_DUD": ("airline", "days_until_departure"),
    "GLOBAL_DUD": ("days_until_departure",),
    "GLOBAL": (),
}


def batch_times(df: DataFrame, batch: str = "session_key") -> DataFrame:
    """Completion time and size of every batch: two rows per calendar day."""
    return df.groupBy(batch).agg(F.max("scraped_at").alias("feature_time"), F.count(F.lit(1)).alias("batch_offer_count"))


def batch_feature_time(df: DataFrame, batch: str = "session_key", batches: DataFrame | None = None) -> DataFrame:
    """Batch completion time and size on every row.

    Pass ``batches`` as a written table: its file size is known when the join is planned, so a small
    one is broadcast below the session's threshold and the offers are not shuffled; a large one falls
    back to a shuffled join.
    """
    return join_on(df, batch_times(df, batch) if batches is None else batches, [batch], "left")


def modal_value(df: DataFrame, keys: Sequence[str], column: str, name: str = "modal") -> DataFrame:
    """Unique most frequent value, MIXED on a tie, UNKNOWN when every value is null."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n", F.when(F.col(column).isNull(), -1).otherwise(F.col("n")))
    top = counts.withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(F.col("n").desc()))).where("r = 1")
    value = F.when(F.max("n") == -1, "UNKNOWN").when(F.count(F.lit(1)) > 1, "MIXED").otherwise(F.min(column))
    return top.groupBy(*keys).agg(value.alias(name))


def era_mode():
    """Modal era as one aggregate; the era taxonomy is closed, so two conditional counts decide."""
    fli = F.count_if(F.col("collection_era") == C.FLI_ERA)
    trip = F.count_if(F.col("collection_era") == C.TRIP_ERA)
    return (
        F.when((fli == 0) & (trip == 0), "UNKNOWN")
        .when(fli > trip, C.FLI_ERA)
        .when(trip > fli, C.TRIP_ERA)
        .otherwise("MIXED")
    )


def market_batches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (market, batch). The median keeps one counter per distinct fare, not per row."""
    return df.groupBy(*keys, "session_key").agg(
        F.median("price_vnd").alias("market_price"),
        F.count("price_vnd").alias("market_support"),
        F.max("feature_time").alias("market_time"),
        era_mode().alias("market_era"),
    )


def market_anchor(df: DataFrame, by_era: bool = True, keys: Sequence[str] = MARKET_KEYS) -> DataFrame:
    """Previous batch's market median, support, time and era, and its direction per day.

    Rows are aggregated to batches before the lag, so a window partition is bounded by the calendar.
    """
    full = ["collection_era", *keys] if by_era else list(keys)
    w = Window.partitionBy(*full).orderBy("market_time", "session_key")
    b = market_batches(df, full).withColumns(
        {
            "temporal_market_median_price": F.lag("market_price").over(w),
            "temporal_market_support": F.lag("market_support").over(w),
            "temporal_market_time": F.lag("market_time").over(w),
            "temporal_market_collection_era": F.lag("market_era").over(w),
            "__p2": F.lag("market_price", 2).over(w),
            "__t2": F.lag("market_time", 2).over(w),
        }
    )
    days = K.hours_between("__t2", "temporal_market_time") / F.lit(24.0)
    ratio = F.try_divide(F.col("temporal_market_median_price"), F.col("__p2")) - 1
    b = b.withColumn(
        "prior_market_change_pct_per_day", F.when((days > 0) & (F.col("__p2") > 0), F.lit(100.0) * ratio / days)
    ).withColumn("has_prior_market_change", F.col("prior_market_change_pct_per_day").isNotNull().cast("int"))
    b = b.drop("market_price", "market_support", "market_time", "market_era", "__p2", "__t2")
    if by_era:
        b = b.withColumn(
            "temporal_market_collection_era",
            F.when(F.col("temporal_market_time").isNotNull(), F.col("collection_era")),
        )
    return join_on(df, b, [*full, "session_key"], "left").withColumn(
        "temporal_market_age_hours", K.hours_between("temporal_market_time", "feature_time")
    )


def leave_group_out(
    df: DataFrame, cell: Sequence[str] = ("session_key", "route", "flight_date"), member: str = "airline"
) -> DataFrame:
    """Per (cell, member): context made of the other members only.

    Exclusive frames before and after a member replace the pairing of members; a cell holds one row
    per member after the aggregation.
    """
    m = df.groupBy(*cell, member).agg(
        F.min("price_vnd").alias("mn"), F.median("price_vnd").alias("md"), F.count("price_vnd").alias("n")
    )
    order = Window.partitionBy(*cell).orderBy(member)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*cell)
    others = F.count(F.lit(1)).over(whole) - 1
    low = F.least(F.min("mn").over(before), F.min("mn").over(after))
    spread = F.greatest(F.max("md").over(before), F.max("md").over(after)) - F.least(
        F.min("md").over(before), F.min("md").over(after)
    )
    return m.select(
        *cell,
        member,
        low.alias("competitor_min_price_other_airlines"),
        spread.alias("competitor_price_spread_other_airlines"),
        others.alias("competitor_airline_count"),
        (F.sum("n").over(whole) - F.col("n")).alias("competitor_offer_count"),
    ).where(F.col("competitor_airline_count") > 0)


def with_other_airlines(df: DataFrame) -> DataFrame:
    keys = ["session_key", "route", "flight_date", "airline"]
    return join_on(df, leave_group_out(df), keys, "left")


def loo_min(
    df: DataFrame, keys: Sequence[str] = ("session_key", "route", "flight_date", "airline"), value: str = "price_vnd"
) -> DataFrame:
    """Minimum of the group without the row itself, and the number of other rows.

    Only the two smallest distinct values of a group matter; the rank filter is pushed below the shuffle.
    """
    hist = histogram(df, keys, value)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    low = (
        hist.withColumn("r", rank)
        .where("r <= 2")
        .groupBy(*keys)
        .agg(
            F.min(value).alias("__m1"),
            F.max(F.when(F.col("r") == 1, F.col("n"))).alias("__c1"),
            F.max(F.when(F.col("r") == 2, F.col(value))).alias("__m2"),
        )
    )
    size = hist.groupBy(*keys).agg(F.sum("n").alias("__n"))
    out = join_on(df, join_on(size, low, keys), keys, "left")
    alone = (F.col(value) == F.col("__m1")) & (F.col("__c1") == 1)
    return (
        out.withColumn("same_airline_alternative_min_price", F.when(alone, F.col("__m2")).otherwise(F.col("__m1")))
        .withColumn(
            "same_airline_alternative_min_price",
            F.when(F.col("__n") > 1, F.col("same_airline_alternative_min_price")),
        )
        .withColumn("same_airline_alternative_count", F.col("__n") - 1)
        .drop("__m1", "__c1", "__m2", "__n")
    )


def loo_median(
    df: DataFrame,
    keys: Sequence[str] = ("session_key", "route", "flight_date"),
    value: str = "price_vnd",
    name: str = "peer_anchor_vnd",
    support: str = "peer_anchor_support",
) -> DataFrame:
    """Exact median of the group without the row itself.

    Removing one value only shifts which of three central order statistics are used, so a group needs
    those three numbers and its size; they come from the value histogram and join back to the rows.
    """
    hist = histogram(df, keys, value)
    order = Window.partitionBy(*keys).orderBy(value)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.withColumn("hi", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys))
    )
    p = F.floor((F.col("total") - 1) / 2)

    def statistic(rank):
        inside = (F.col("hi") - F.col("n") < rank) & (rank <= F.col("hi"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    stats = ranked.groupBy(*keys).agg(
        F.max("total").alias("__n"),
        statistic(p).alias("__s0"),
        statistic(p + 1).alias("__s1"),
        statistic(p + 2).alias("__s2"),
    )
    v = F.col(value)
    upper = F.when(v <= F.col("__s1"), F.col("__s2")).otherwise(F.col("__s1"))
    lower = F.when(v <= F.col("__s0"), F.col("__s1")).otherwise(F.col("__s0"))
    result = F.when(F.col("__n") % 2 == 0, upper).otherwise((lower + upper) / 2)
    return (
        join_on(df, stats, keys, "left")
        .withColumn(name, F.when(F.col("__n") > 1, result))
        .withColumn(support, F.col("__n") - 1)
        .drop("__n", "__s0", "__s1", "__s2")
    )


def peer_anchor(df: DataFrame) -> DataFrame:
    """Peer median with at least three peers, else the prior market of the same era, else few peers."""
    work = loo_median(df)
    peer, n = F.col("peer_anchor_vnd"), F.col("peer_anchor_support")
    market = F.col("temporal_market_median_price")
    strong = F.coalesce((n >= C.PEER_MIN_SUPPORT) & (peer > 0), F.lit(False))
    prior = F.coalesce(
        (market > 0)
        & (F.col("temporal_market_time") < F.col("feature_time"))
        & (F.col("temporal_market_collection_era") == F.col("collection_era")),
        F.lit(False),
    )
    weak = F.coalesce((n >= 1) & (peer > 0), F.lit(False))
    price = F.col("price_vnd").cast("double")
    return (
        work.withColumn("anchor_vnd", F.when(strong, peer).when(prior, market).when(weak, peer))
        .withColumn(
            "anchor_source",
            F.when(strong, "CURRENT_PEER")
            .when(prior, "PRIOR_HISTORICAL")
            .when(weak, "CURRENT_PEER_LOW_SUPPORT")
            .otherwise("UNAVAILABLE"),
        )
        .withColumn("anchor_is_observed_peer", strong.cast("int"))
        .withColumn("anchor_is_fallback", (~strong & F.col("anchor_vnd").isNotNull()).cast("int"))
        .withColumn(
            "historical_anchor_time",
            F.when(F.col("anchor_source") == "PRIOR_HISTORICAL", F.col("temporal_market_time")),
        )
        .withColumn("anchor_log", K.safe_log("anchor_vnd"))
        .withColumn("anchor_support_log1p", K.safe_log1p("peer_anchor_support"))
        .withColumn(
            "current_relative_log",
            F.when((price > 0) & (F.col("anchor_vnd") > 0), F.ln(price / F.col("anchor_vnd"))),
        )
    )


def session_pairs(df: DataFrame) -> DataFrame:
    """Each batch with its immediate predecessor; the lag runs over the batch calendar only."""
    s = df.groupBy("session_key").agg(
        F.min("feature_time").alias("target_session_time"),
        F.min("session_date").alias("target_session_date"),
        F.min("session_label").alias("target_session_label"),
        era_mode().alias("target_collection_era"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("target_session_time", "session_key")
    return s.withColumns(
        {
            "source_session_key": F.lag("session_key").over(w),
            "source_session_time": F.lag("target_session_time").over(w),
            "source_session_date": F.lag("target_session_date").over(w),
            "source_session_label": F.lag("target_session_label").over(w),
            "source_collection_era": F.lag("target_collection_era").over(w),
        }
    ).where(F.col("source_session_key").isNotNull())


def prior_batch_anchor(
    df: DataFrame, levels: Mapping[str, Sequence[str]] = ANCHOR_LEVELS, value: str = "price_vnd"
) -> DataFrame:
    """Median fare and support of the immediately preceding batch, at the first level that has one.

    The levels come from one histogram of the offers and are resolved on the distinct target cells, so the offer rows
    are read once whatever the number of levels, and a whole batch as one cell is spread over its values.
    """
    finest = list(dict.fromkeys(c for keys in levels.values() for c in keys))
    shift = session_pairs(df).select("session_key", "source_session_key")
    cells = join_on(df.select("session_key", *finest).distinct(), shift, ["session_key"])
    source = {name: ("source_session_key", *keys) for name, keys in levels.items()}
    resolved = first_supported_quantiles(
        df.withColumn("source_session_key", F.col("session_key")), cells.drop("session_key"), value, source,
        {"prior_anchor_vnd": 0.5}, [1] * len(levels), "prior_anchor_support", "anchor_fallback_level",
    )
    resolved = join_on(cells, resolved, ["source_session_key", *finest])
    level = F.coalesce("anchor_fallback_level", F.lit("UNAVAILABLE"))
    return join_on(df, resolved.withColumn("anchor_fallback_level", level), ["session_key", *finest])


def prior_market_context(df: DataFrame) -> DataFrame:
    """Range, airlines and offers of the previous batch per route and horizon."""
    keys = ["route", "days_until_departure"]
    stats = df.groupBy("session_key", *keys).agg(
        F.min("price_vnd").alias("prior_route_min_price"),
        F.max("price_vnd").alias("prior_route_max_price"),
        F.countDistinct("airline").alias("prior_competitor_airline_count"),
        F.count("price_vnd").alias("prior_competitor_offer_count"),
    )
    shift = session_pairs(df).select(F.col("source_session_key").alias("session_key"), F.col("session_key").alias("__next"))
    stats = join_on(stats, shift, ["session_key"]).drop("session_key").withColumnRenamed("__next", "session_key")
    spread = F.col("prior_route_max_price") - F.col("prior_route_min_price")
    return (
        join_on(df, stats, ["session_key", *keys], "left")
        .withColumn("prior_route_min_log_price", K.safe_log("prior_route_min_price"))
        .withColumn("prior_route_price_spread_log1p", K.safe_log1p(spread))
    )


RESIDUAL_LEVELS = {
    "ROUTE_AIRLINE_HHMM_DUD_SESSION": ("route", "airline", "departure_minute", "target_dud", "session_label"),
    "ROUTE_AIRLINE_PERIOD_DUD_SESSION": ("route", "airline", "departure_period", "target_dud", "session_label"),
    "ROUTE_AIRLINE_DUD_SESSION": ("route", "airline", "target_dud", "session_label"),
    "ROUTE_DUD_SESSION": ("route", "target_dud", "session_label"),
    "DUD_SESSION": ("target_dud", "session_label"),
}


def backoff_quantiles(
    train: DataFrame,
    target: DataFrame,
    value: str,
    levels: Mapping[str, Sequence[str]] = RESIDUAL_LEVELS,
    probs: Mapping[str, float] | None = None,
    min_support: int = C.BACKOFF_MIN_SUPPORT,
    default: float | None = 0.0,
    default_level: str = "ZERO_RESIDUAL_ANCHOR",
    pooled_min_support: int | None = None,
) -> DataFrame:
    """Exact training quantiles of the first level with enough rows.

    The training rows are read once, into one histogram from which all levels are summed. The levels are
    resolved on the distinct target cells; the target rows are shuffled once.
    """
    probs = probs or {"backoff_value": 0.5}
    finest = list(dict.fromkeys(c for keys in levels.values() for c in keys))
    least = [min_support if keys or pooled_min_support is None else pooled_min_support for keys in levels.values()]
    cells = target.select(*finest).distinct()
    resolved = first_supported_quantiles(train, cells, value, levels, probs, least, "backoff_support", "backoff_level").select(
        *finest,
        *[F.coalesce(F.col(n), F.lit(default).cast("double")).alias(n) for n in probs],
        F.coalesce("backoff_support", F.lit(0)).alias("backoff_support"),
        F.coalesce("backoff_level", F.lit(default_level)).alias("backoff_level"),
    )
    return join_on(target, resolved, finest)


def market_event_lane(df: DataFrame) -> DataFrame:
    """Batch medians and support per (era, route, airline, horizon bucket)."""
    bucket = K.right_closed_band("days_until_departure", C.DUD_BUCKETS)
    return (
        df.withColumn("booking_window_bucket", bucket)
        .groupBy("collection_era", "route", "airline", "booking_window_bucket", "session_key")
        .agg(
            F.max("feature_time").alias("event_time"),
            F.median("price_vnd").alias("median_price"),
            F.count(F.lit(1)).alias("support"),
        )
    )
