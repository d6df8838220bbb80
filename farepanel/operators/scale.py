"""Building blocks that keep an ordered or exact computation spread out when one key is huge.

An ordinary window sends a whole key to one task. Here a large key is first cut into buckets of about
equally many values: the bucket is a monotone function of the value, so running totals over a key are the
total of all earlier buckets (a short list per key) plus a running total inside one bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.session import materialise

BUCKET_VALUES = 100_000  # distinct values of a key that one task may order
BUCKETS = 1024  # parts of a larger key


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the key columns of the left side are kept."""
    if not keys:  # right is an aggregate without keys: one row at most
        return left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def equi_depth(hist: DataFrame, keys: Sequence[str], value: str, name: str = "__bucket") -> DataFrame:
    """Add a monotone bucket number per key: 0 for keys of up to ``BUCKET_VALUES`` distinct values, else the place among
    splitters that cut the key's distinct values into about ``BUCKETS`` equal parts.

    The splitters come from a mergeable quantile sketch of the histogram's own values, so any offset, unit or shape of
    the values is cut alike. Only keys above the bound are sketched; the sketch is of fixed size. The histogram and, if
    there is a large key, the numbered result are written tables: each is read several times, and Spark would make it
    again for every reader that needs other columns.
    """
    keys, v = list(keys), F.col(value).cast("double")
    hist = materialise(hist, "histogram")
    large = _large_keys(hist, keys)
    return hist.withColumn(name, F.lit(0)) if large is None else _numbered(hist, large, keys, v, name)


def _large_keys(hist: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys of a written histogram with more than ``BUCKET_VALUES`` rows, None if there is no such key."""
    large = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r")).where(F.col("__r") > BUCKET_VALUES)
    return None if large.isEmpty() else large


def _numbered(hist: DataFrame, large: DataFrame, keys: Sequence[str], v: Column, name: str) -> DataFrame:
    """The written histogram with its bucket numbers, as a written table."""
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    sketched = join_on(hist, large, keys, "left_semi") if keys else with_scalars(hist, large)
    cuts = sketched.groupBy(*keys).agg(F.percentile_approx(v, shares, F.lit(20 * BUCKETS)).alias("__cuts"))
    work = join_on(hist, cuts, keys, "left")
    # number of splitters below the value, by bisection; steps beyond the end of the list change nothing
    work = work.withColumn(name, F.lit(0))
    for step in (1 << i for i in reversed(range((BUCKETS - 1).bit_length()))):
        further = F.get("__cuts", F.col(name) + (step - 1)) < v
        work = work.withColumn(name, F.when(further, F.col(name) + step).otherwise(F.col(name)))
    return materialise(work.drop("__cuts"), "buckets")


def running_totals(
    hist: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str] | Mapping[str, Column], then: Sequence[str] = ()
) -> DataFrame:
    """Add ``<m>_before`` (strictly smaller values) and ``<m>_total`` per key.

    ``hist`` holds one row per (keys, value). With ``then`` it may hold several: ``<m>_before`` is then over what comes
    earlier by (value, then). Measures are columns, or names with expressions, which are made where they are summed. No
    task sees more than one value bucket of one key; if no key is large, one window gives both, without buckets.
    """
    keys, given = list(keys), hist.columns
    measures = dict(measures) if isinstance(measures, Mapping) else {m: F.col(m) for m in measures}
    hist = materialise(hist, "histogram")
    large = _large_keys(hist, keys)
    zero = F.lit(0)
    if large is None:
        order = Window.partitionBy(*keys).orderBy(value, *then)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return hist.select(
            *given,
            *[F.coalesce(F.sum(e).over(before), zero).alias(f"{m}_before") for m, e in measures.items()],
            *[F.sum(e).over(whole).alias(f"{m}_total") for m, e in measures.items()],
        )
    work = _numbered(hist, large, keys, F.col(value).cast("double"), "__bucket")
    totals = work.groupBy(*keys, "__bucket").agg(*[F.sum(e).alias(f"__{m}") for m, e in measures.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "__bucket",
        *[F.coalesce(F.sum(f"__{m}").over(earlier), zero).alias(f"__{m}_base") for m in measures],
        *[F.sum(f"__{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value, *then).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_on(work, totals, [*keys, "__bucket"])
    return joined.select(
        *given,
        *[(F.col(f"__{m}_base") + F.coalesce(F.sum(e).over(inside), zero)).alias(f"{m}_before") for m, e in measures.items()],
        *[F.col(f"{m}_total") for m in measures],
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """Distinct values with counts: combines before the shuffle and spreads a hot key over its values."""
    aggregates = measures or {"n": F.lit(1)}
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in aggregates.items()])
    )


def small_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *others: Column) -> DataFrame:
    """Exact median per key of every column, and other aggregates, for keys that mostly hold one or two rows.

    The median of up to two values is the middle of the smallest and the largest, which plain aggregates give; only the
    rows of larger groups go through ``percentile``, whose state per group and column is a map. The frame is read three
    times, so it should be a written table.
    """
    keys = list(keys)
    crowded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 2).select(*keys)
    crowded = materialise(crowded, "crowded")
    middle = lambda c: (F.lit(0.5) * F.min(c) + F.lit(0.5) * F.max(c)).alias(c)
    few = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *others, *[middle(c) for c in columns])
    many = join_on(df, crowded, keys, "left_semi").groupBy(*keys).agg(*others, *[F.percentile(c, 0.5).alias(c) for c in columns])
    return few.where(F.col("__n") <= 2).drop("__n").unionByName(many)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
    support: str | None = None,
) -> DataFrame:
    """Exact quantiles per key, ``linear`` interpolation or the ``higher`` order statistic."""
    keys = list(keys)
    ranked = running_totals(histogram(df, keys, value), keys, value, ["n"])
    return quantiles_of_totals(ranked, keys, value, probs, method, support)


def quantiles_of_totals(
    ranked: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float | Column],
    method: str = "linear",
    support: str | None = None,
) -> DataFrame:
    """Quantiles from ``running_totals`` of a histogram; a probability may be a function of the keys."""
    keys = list(keys)
    v = F.col(value).cast("double")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), v))

    aggregates, finals = [], []
    for name, q in probs.items():
        q = q if isinstance(q, Column) else F.lit(float(q))
        position = (F.col("n_total") - 1) * q
        if method == "higher":
            aggregates.append(at(F.ceil(position)).alias(name))
            finals.append(F.col(name))
            continue
        aggregates += [at(F.floor(position)).alias(f"__{name}_lo"), at(F.ceil(position)).alias(f"__{name}_hi")]
        lo, hi, place = F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), (F.col("__n") - 1) * q
        finals.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    grouped = ranked.groupBy(*keys).agg(F.max("n_total").alias("__n"), *aggregates)
    extra = [F.col("__n").alias(support)] if support else []
    return grouped.select(*keys, *extra, *finals)


def ranks(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """(keys, value, ``<prefix>before``, ``<prefix>ties``, ``<prefix>n``): one row per distinct non-null value of a key."""
    return running_totals(histogram(df, keys, value), keys, value, ["n"]).select(
        *keys,
        value,
        F.col("n_before").alias(f"{prefix}before"),
        F.col("n").alias(f"{prefix}ties"),
        F.col("n_total").alias(f"{prefix}n"),
    )


def with_rank(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Add ``<prefix>before``, ``<prefix>ties`` and ``<prefix>n`` for every row with a non-null value."""
    return join_on(df, ranks(df, keys, value, prefix), [*keys, value], "left")


def average_rank(prefix: str = "") -> Column:
    """Rank with ties averaged, from the columns of ``with_rank``."""
    return F.col(f"{prefix}before") + (F.col(f"{prefix}ties") + 1) / F.lit(2.0)


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column | str], name: str) -> DataFrame:
    """1-based position per key by (value, ties), null for rows without a value.

    Rows are range-partitioned by all sort columns, with edges sampled from the data, so neither a huge key nor a
    value that very many rows share meets in one task. Counts per key and range give the offsets.
    """
    keys = list(keys)
    order = [*(F.col(k) for k in keys), F.col(value).asc_nulls_last(), *ties]
    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__part").orderBy(F.col(value).asc_nulls_last(), *ties)
    placed = join_on(parts.withColumn("__i", F.row_number().over(inside)), offsets, [*keys, "__part"])
    number = F.when(F.col(value).isNotNull(), F.col("__o") + F.col("__i"))
    return placed.withColumn(name, number).drop("__part", "__o", "__i")


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group statistics joined back to the rows: partial aggregation first, then a splittable join."""
    return join_on(df, df.groupBy(*keys).agg(*aggregates), keys, "left")


def scalar(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One-row aggregate that can be attached to every row with ``with_scalars``."""
    return df.agg(*aggregates)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a global aggregate; its size is one row by construction."""
    return df.crossJoin(F.broadcast(one_row))


def positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """0-based global position by a unique order column, without a single-partition sort."""
    return row_numbers(df, [], order, [order], name).withColumn(name, F.col(name) - 1)


def neighbours(queries: DataFrame, points: DataFrame, x: str, value: str) -> DataFrame:
    """Distinct ``x`` of the queries with the nearest points: ``below`` (at or before) and ``above`` (after), structs of
    (x, value) or null. Windows run inside one value bucket, and over the list of buckets."""
    point = F.struct(F.col(x).alias("x"), F.col(value).alias("v")).alias("__p")
    points = points.select(x, point)
    asked = queries.select(x).where(F.col(x).isNotNull()).distinct().withColumn("__p", F.lit(None).cast(points.schema["__p"].dataType))
    both = equi_depth(points.unionByName(asked), [], x)
    whole = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    ends = both.groupBy("__bucket").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi")).select(
        "__bucket",
        F.last("hi", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.first("lo", True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
    )
    inside = Window.partitionBy("__bucket").orderBy(F.col(x), F.col("__p").isNull())
    near = both.select(
        x, "__p", "__bucket",
        F.last("__p", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
        F.first("__p", True).over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("above"),
    ).where(F.col("__p").isNull())
    return join_on(near, ends, ["__bucket"]).select(x, F.coalesce("below", "__earlier").alias("below"), F.coalesce("above", "__later").alias("above"))
