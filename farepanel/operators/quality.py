"""Cleaning, deduplication, coverage and contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.scale import attach, with_scalars

RAW_TYPES = {
    "scraped_at": "timestamp_ntz",
    "session_id": "timestamp_ntz",
    "flight_date": "date",
    "departure_time": "timestamp_ntz",
    "price_vnd": "double",
    "days_until_departure": "int",
}
REQUIRED = (
    "scraped_at", "session_id", "route", "airline", "flight_date",
    "departure_time", "days_until_departure", "price_vnd",
)
IDENTITY = ("session_key", "route", "airline", "flight_date", "departure_time", "days_until_departure")


def cast_offers(df: DataFrame) -> DataFrame:
    """Typed columns; a cell that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in RAW_TYPES.items() if c in df.columns})


def normalise(df: DataFrame) -> DataFrame:
    """Typed offers without null or non-positive fares, with batch and identity columns."""
    typed = cast_offers(df).na.drop(subset=list(REQUIRED)).where(F.col("price_vnd") > 0)
    minute = K.minute_of_day("departure_time")
    return (
        typed.withColumn("session_date", K.session_date("session_id"))
        .withColumn("session_label", K.session_label("session_id"))
        .withColumn("session_key", K.session_key("session_date", "session_label"))
        .withColumn("departure_hhmm", K.hhmm(minute))
    )


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key as an aggregate, so repeats of a hot key are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order]
    rank = F.struct(*[F.col(c) for c in [*order, *tie]])
    best = df.groupBy(*keys).agg(F.max(rank).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def completed_batch_offers(df: DataFrame) -> DataFrame:
    return dedup_latest(df, ["session_key", "schedule_slot_id"], ["scraped_at", "session_id"])


def exact_duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows before and after removal of full-row repeats."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return grouped.agg(
        F.sum("__n").alias("raw_rows"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.sum("__n") - F.count(F.lit(1))).alias("duplicates_removed"),
    )


def flag_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_exact_duplicate") -> DataFrame:
    """Mark every member of a repeated key."""
    return attach(df, keys, F.count(F.lit(1)).alias("__n")).withColumn(name, F.col("__n") > 1).drop("__n")


def select_eras(df: DataFrame, ranges: dict[str, tuple[str | None, str | None]], cutoff: str) -> DataFrame:
    """Keep each era inside its own date range; plain predicates, so a partitioned scan prunes."""
    keep = F.lit(False)
    for era, (first, last) in ranges.items():
        hit = F.col("collection_era") == era
        if first:
            hit = hit & (F.col("session_date") >= F.lit(first).cast("date"))
        if last:
            hit = hit & (F.col("session_date") <= F.lit(last).cast("date"))
        keep = keep | hit
    required = [c for c in REQUIRED if c in df.columns and c != "scraped_at"]
    return (
        df.where(keep & (F.col("session_date") <= F.lit(cutoff).cast("date")))
        .na.drop(subset=required)
        .where(F.col("price_vnd") > 0)
    )


def era_violations(df: DataFrame, domain: Sequence[str] = (C.FLI_ERA, C.TRIP_ERA)) -> DataFrame:
    """Counts of unknown era values and of malformed or unknown transitions."""
    era, parts = F.col("collection_era"), F.split(F.col("transition"), "->")
    bad_transition = (F.size(parts) != 2) | ~F.forall(parts, lambda p: p.isin(*domain))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(era.isin(*domain), F.lit(False))).alias("unknown_eras"),
        F.count_if(F.coalesce(bad_transition, F.lit(True))).alias("bad_transitions"),
    )


def normalise_eras(df: DataFrame, domain: Sequence[str] = (C.FLI_ERA, C.TRIP_ERA)) -> DataFrame:
    """Pass rows through and fail the job at the first unknown era."""
    era = F.col("collection_era")
    message = F.concat(F.lit("unknown collection era: "), F.coalesce(era, F.lit("null")))
    return df.withColumn("collection_era", F.when(era.isin(*domain), era).otherwise(F.raise_error(message)))


def tier_stats(df: DataFrame) -> DataFrame:
    """Row counts by fare tier."""
    tiered = df.withColumn("price_tier", K.price_tier("price_vnd", "route"))
    return tiered.agg(
        F.count(F.lit(1)).alias("all_rows"),
        *[
            F.count_if(F.col("price_tier") == tier).alias(f"{tier}_rows")
            for tier in ("standard", "high", "extreme", "unknown", "soldout")
        ],
    )


def batch_coverage(df: DataFrame, batch: Sequence[str], windows=C.BOOKING_WINDOWS, routes=20, airlines=5) -> DataFrame:
    """Rows, routes, airlines and horizon set of every batch against the expectation."""
    grouped = df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("route").alias("routes"),
        F.countDistinct("airline").alias("airlines"),
        F.array_join(F.sort_array(F.collect_set("days_until_departure")).cast("array<string>"), ",").alias("duds"),
    )
    expected = ",".join(str(w) for w in sorted(windows))
    return grouped.withColumn(
        "complete",
        (F.col("duds") == expected) & (F.col("routes") == routes) & (F.col("airlines") == airlines),
    )


def coverage_matrix(df: DataFrame, first: str, last: str, windows=C.BOOKING_WINDOWS, routes=20, min_airlines=4):
    """Every (date, half-day) of a range with its coverage or ABSENT; nothing is imputed."""
    from farepanel.sources.files import date_spine

    spine = date_spine(df.sparkSession, first, last, "session_date").withColumn(
        "session_label", F.explode(F.array(F.lit("AM"), F.lit("PM")))
    )
    seen = batch_coverage(df, ["session_date", "session_label"], windows, routes).drop("complete")
    expected = ",".join(str(w) for w in sorted(windows))
    full = (
        (F.col("duds") == expected) & (F.col("routes") == routes) & (F.col("airlines") >= min_airlines)
    )
    return spine.join(seen, ["session_date", "session_label"], "left").withColumn(
        "status",
        F.when(F.col("rows").isNull(), "ABSENT").when(full, "COMPLETE").otherwise("INCOMPLETE"),
    ).withColumn("rows", F.coalesce("rows", F.lit(0)))


def validate_batches(
    df: DataFrame, windows=C.BOOKING_WINDOWS, routes=20, airlines=C.AIRLINES, min_airlines=4, subset: Column | None = None
) -> DataFrame:
    """Store gate for all batches in one grouped aggregate.

    A batch needs exactly the given windows, all routes, no unknown airline and every known one. ``subset`` marks
    batches, over their two key columns, that may lack airlines down to ``min_airlines``: declared morning-only ones.
    Repeated slots are reported and fail nothing.
    """
    slots = df.groupBy("session_date", "session_label", "schedule_slot_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("route").alias("route"),
        F.min("airline").alias("airline"),
        F.collect_set("days_until_departure").alias("duds"),
    )
    grouped = slots.groupBy("session_date", "session_label").agg(
        F.sum("n").alias("rows"),
        F.countDistinct("route").alias("routes"),
        F.countDistinct("airline").alias("airlines"),
        F.count_if(~F.col("airline").isin(*airlines)).alias("unknown_airline_slots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("duds")))).alias("duds"),
        F.count_if(F.col("n") > 1).alias("duplicate_slots"),
    )
    enough = F.col("airlines") == len(airlines)
    if subset is not None:
        enough = enough | (subset & (F.col("airlines") >= min_airlines))
    expected = F.array(*[F.lit(w).cast("int") for w in sorted(windows)])
    ready = (
        (F.col("routes") == routes)
        & enough
        & (F.col("unknown_airline_slots") == 0)
        & (F.transform("duds", lambda d: d.cast("int")) == expected)
    )
    return grouped.withColumn("windows", F.size("duds").cast("bigint")).withColumn(
        "status", F.when(ready, "READY").otherwise("FAILED")
    ).drop("duds")


def store_status(batches: DataFrame) -> DataFrame:
    state = F.col("status")
    return batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(state == "READY").alias("ready_batches"),
        F.count_if(state == "FAILED").alias("failed_batches"),
        F.count_if(state == "STAGING").alias("staging_batches"),
        F.coalesce(F.sum(F.when(state == "READY", F.col("rows"))), F.lit(0)).alias("ready_rows"),
        F.min(F.when(state == "READY", F.col("session_date"))).alias("first_ready"),
        F.max(F.when(state == "READY", F.col("session_date"))).alias("last_ready"),
    )


def registry(df: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """First and last sighting per (route, airline), merged with an earlier registry."""
    seen = df.groupBy("route", "airline").agg(
        F.min("session_date").alias("first_seen"), F.max("session_date").alias("last_seen")
    )
    if prior is not None:
        seen = seen.unionByName(prior.select("route", "airline", "first_seen", "last_seen"))
    return seen.groupBy("route", "airline").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def latest_ready(batches: DataFrame) -> DataFrame:
    """Newest READY batch, PM before AM; the one-row limit is the report itself."""
    return (
        batches.where(F.col("status") == "READY")
        .orderBy(F.col("session_date").desc(), F.col("session_label").desc())
        .limit(1)
    )


def unknown_pairs(df: DataFrame, known: DataFrame) -> DataFrame:
    pairs = df.groupBy("route", "airline").agg(F.count(F.lit(1)).alias("rows"))
    return pairs.join(known, ["route", "airline"], "left_anti")


def leakage_guard(
    df: DataFrame, predictors: Sequence[str], forbidden: Sequence[str], feature_time="feature_time", label_time="label_time"
) -> DataFrame:
    """Contract violations: columns from the schema, time order from one aggregate."""
    present = set(df.columns)
    late = ~F.coalesce(F.col(feature_time) < F.col(label_time), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len([p for p in predictors if p not in present])).alias("missing_predictors"),
        F.lit(len([p for p in predictors if p in set(forbidden)])).alias("forbidden_predictors"),
        F.count_if(late).alias("time_violations"),
    )


def pit_violations(df: DataFrame) -> DataFrame:
    """Rows whose history is not strictly prior, comes from the same batch, or crosses eras."""
    prior_time, market_time = F.col("previous_schedule_time"), F.col("temporal_market_time")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(prior_time >= F.col("feature_time")).alias("history_not_prior"),
        F.count_if(market_time >= F.col("feature_time")).alias("market_not_prior"),
        F.count_if(F.col("previous_schedule_session_key") == F.col("session_key")).alias("same_batch_history"),
        F.count_if(F.col("previous_schedule_collection_era") != F.col("collection_era")).alias("cross_era_history"),
        F.count_if(F.col("temporal_market_collection_era") != F.col("collection_era")).alias("cross_era_market"),
    )


def snapshot_gate(df: DataFrame, cutoff: str, windows=C.BOOKING_WINDOWS) -> DataFrame:
    dud = F.col("days_until_departure")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("session_date").isNull() | F.col("flight_date").isNull()).alias("null_dates"),
        F.count_if(~dud.between(1, 60)).alias("horizon_out_of_range"),
        F.count_if(~dud.isin(*windows)).alias("off_grid"),
        F.count_if(~(F.col("price_vnd") > 0)).alias("non_positive_prices"),
        F.coalesce(F.max("session_date") == F.lit(cutoff).cast("date"), F.lit(False)).alias("ends_at_cutoff"),
    )


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1", require_full: bool = False
) -> DataFrame:
    """Equi-join whose declared cardinality is enforced inside the same job.

    The side that must be unique is grouped by key first, which adds no shuffle beyond the join's own.
    """
    left_kind, right_kind = validate.split(":")

    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        grouped = df.groupBy(*on).agg(
            F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in rest]
        )
        first = on[0]
        checked = F.when(F.col("__n") == 1, F.col(first)).otherwise(
            F.raise_error(F.lit(f"{side} side repeats the join key"))
        )
        return grouped.withColumn(first, checked).drop("__n").select(*df.columns)

    left = unique(left, "left") if left_kind == "1" else left
    right = unique(right, "right") if right_kind == "1" else right
    if not require_full:
        return left.join(right, list(on), how)
    joined = left.join(right.withColumn("__hit", F.lit(True)), list(on), "left")
    first = on[0]
    checked = F.when(F.col("__hit"), F.col(first)).otherwise(F.raise_error(F.lit("join does not cover the left side")))
    return joined.withColumn(first, checked).drop("__hit")


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cardinality and coverage of an equi-join without emitting its rows."""
    l = left.groupBy(*on).agg(F.count(F.lit(1)).alias("ln"))
    r = right.groupBy(*on).agg(F.count(F.lit(1)).alias("rn"))
    both = l.join(r, list(on), "full").select(
        F.coalesce("ln", F.lit(0)).alias("ln"), F.coalesce("rn", F.lit(0)).alias("rn")
    )
    return both.agg(
        F.sum("ln").alias("left_rows"),
        F.sum("rn").alias("right_rows"),
        F.count_if(F.col("ln") > 1).alias("left_repeated_keys"),
        F.count_if(F.col("rn") > 1).alias("right_repeated_keys"),
        F.sum(F.when(F.col("rn") == 0, F.col("ln")).otherwise(0)).alias("left_uncovered_rows"),
        F.sum(F.col("ln") * F.col("rn")).alias("joined_rows"),
    )


def parity(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Mismatches per column between two versions of a table; null equals null."""
    types = dict(a.dtypes)
    left = a.select(key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(1).alias("__l"))
    right = b.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("__r"))
    both = left.join(right, key, "full")

    def differs(c: str) -> Column:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        if types[c] in ("double", "float"):
            return F.coalesce(F.abs(l - r) > tolerance, l.isNull() != r.isNull())
        return ~l.eqNullSafe(r)

    matched = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched_rows"),
        F.count_if(F.col("__r").isNull()).alias("left_only"),
        F.count_if(F.col("__l").isNull()).alias("right_only"),
        *[F.count_if(matched & differs(c)).alias(f"diff_{c}") for c in columns],
    )


def isolation_audit(a: DataFrame, b: DataFrame, boundary: str) -> DataFrame:
    """Row and query overlap of two blocks and the label boundary between them."""
    ids = a.select("offer_id").distinct().join(b.select("offer_id").distinct(), "offer_id", "left_semi")
    queries = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id", "left_semi")
    edge = F.lit(boundary).cast("timestamp_ntz")
    out = a.agg(F.count(F.lit(1)).alias("rows_a"), F.max("session_date").alias("last_a"))
    out = with_scalars(out, b.agg(
        F.count(F.lit(1)).alias("rows_b"),
        F.min("session_date").alias("first_b"),
        F.count_if(F.col("label_time") < edge).alias("labels_before_boundary_b"),
    ))
    out = with_scalars(out, ids.agg(F.count(F.lit(1)).alias("row_overlap")))
    out = with_scalars(out, queries.agg(F.count(F.lit(1)).alias("query_overlap")))
    return out.withColumn("isolated", (F.col("row_overlap") == 0) & (F.col("query_overlap") == 0))


def ensemble_mean(parts: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Mean prediction over members; ``aligned`` is false for a key some member lacks or repeats."""
    union = parts[0].select(key, *columns)
    for part in parts[1:]:
        union = union.unionByName(part.select(key, *columns))
    return union.groupBy(key).agg(
        *[F.avg(c).alias(c) for c in columns], (F.count(F.lit(1)) == len(parts)).alias("aligned")
    )


def union_sources(parts: Sequence[DataFrame], keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Sources by column name, then the latest scrape per identity across all of them."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return dedup_latest(union, list(keys), ["scraped_at"])


def union_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of tables that must have the same column set."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"column sets differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)
