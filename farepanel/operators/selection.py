"""Sorting, top-k per group and the deterministic samplers of the reference behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.operators.scale import join_on, positions, row_numbers, with_scalars

CANONICAL_ORDER = (
    "scraped_at", "session_id", "route", "flight_date", "days_until_departure",
    "airline", "flight_no", "departure_time", "price_vnd",
)


def canonical_sort(df: DataFrame, keys: Sequence[str] = CANONICAL_ORDER) -> DataFrame:
    """Total order for a sink: a range-partitioned sort with the identity as last key."""
    return df.orderBy(*keys, "offer_id")


def evenly_spaced(position: Column, n: Column, limit: int) -> Column:
    """Whether a 0-based position is one of ``limit`` evenly spaced ones (floor(i*(n-1)/(limit-1)))."""
    i = F.ceil(position * F.lit(limit - 1) / F.greatest(n - 1, F.lit(1))).cast("bigint")
    hit = F.floor(i * (n - 1) / F.lit(limit - 1)).cast("bigint") == position
    return (n <= limit) | (hit & (i <= limit - 1))


def even_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """``limit`` evenly spaced rows in key order; the positional index needs no single-partition sort."""
    numbered = with_scalars(positions(df, order, "__p"), df.agg(F.count(F.lit(1)).alias("__n")))
    return numbered.where(evenly_spaced(F.col("__p"), F.col("__n"), limit)).drop("__p", "__n")


PUSHED = 1000  # largest row-number limit that Spark applies before the exchange by default


def quota_per_group(df: DataFrame, groups: Sequence[str], order: str, limit: int, ceil: bool) -> DataFrame:
    """First rows of every group up to a shared quota, with their place ``__r``; one number reaches the driver.

    A small quota is a row-number filter, of which every partition first keeps its own share; a large one, where few
    groups hold many rows, takes places from range partitions, so that no task sorts a whole group.
    """
    count = max(df.select(*groups).distinct().count(), 1)
    quota = max(8, -(-limit // count) if ceil else limit // count)
    if quota <= PUSHED:
        placed = df.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    else:
        placed = row_numbers(df, groups, order, [], "__r")
    return placed.where(F.col("__r") <= quota)


def stratified_head(df: DataFrame, date: str, stratum: str, order: str, limit: int) -> DataFrame:
    """Quota per (date, stratum) in key order, then evenly spaced rows down to the limit.

    A table within the limit is returned whole.
    """
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    groups = [date, stratum]
    head = quota_per_group(df, groups, order, limit, ceil=True)
    sizes = head.groupBy(*groups).agg(F.count(F.lit(1)).alias("__c"))
    # One row per (date, stratum): bounded by the calendar, not by the data.
    w = Window.partitionBy(F.lit(0)).orderBy(*groups)
    offsets = sizes.withColumn(
        "__o", F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("__n", F.sum("__c").over(Window.partitionBy(F.lit(0))))
    placed = join_on(head, offsets, groups)
    kept = placed.where(evenly_spaced(F.col("__o") + F.col("__r") - 1, F.col("__n"), limit))
    kept = kept.drop("__c", "__o", "__n", "__r")
    small = with_scalars(df, total).where(F.col("__all") <= limit).drop("__all")
    large = with_scalars(kept, total).where(F.col("__all") > limit).drop("__all")
    return small.unionByName(large)


def balanced_recent(df: DataFrame, date: str, target: str, order: str, max_rows: int = 4096, max_dates: int = 24, classes: int = 20) -> DataFrame:
    """Last dates only: a quota per (date, target) if the target has two to ``classes`` values, else evenly spaced rows."""
    dates = df.select(date).distinct()
    recent = dates.withColumn("__d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(date).desc())))
    work = df.join(recent.where(F.col("__d") <= max_dates).select(date), date, "left_semi")
    seen = work.where(F.col(target).isNotNull()).select(target).distinct().limit(classes + 1).count()
    if 1 < seen <= classes:
        return quota_per_group(work.where(F.col(target).isNotNull()), [date, target], order, max_rows, ceil=False).drop("__r")
    return even_sample(work, order, max_rows)


def topk_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)
