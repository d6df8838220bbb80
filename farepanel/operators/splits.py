"""Walk-forward splits with label-time purging, weights, encoders and feature variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.scale import (
    average_rank, exact_quantiles, join_on, row_numbers, with_rank, with_scalars,
)
from farepanel.session import materialise


def fold_rows(df: DataFrame, folds: Sequence[tuple]) -> DataFrame:
    """Rows fanned out over the fixed fold list, each with its fold bounds."""
    specs = [
        F.struct(
            F.lit(name).alias("fold"),
            F.lit(role).alias("fold_role"),
            F.lit(start).cast("date").cast("timestamp_ntz").alias("fold_start"),
            F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz").alias("fold_end"),
        )
        for name, role, start, end in folds
    ]
    return df.withColumn("__f", F.explode(F.array(*specs))).select("*", "__f.*").drop("__f")


def outer_split(
    df: DataFrame, folds: Sequence[tuple], mode: str = "CLASSIFICATION", feature: str = "feature_time", label: str = "label_time"
) -> DataFrame:
    """(fold, role) for every row in one pass: expanding train purged by label time, then validation."""
    rows = fold_rows(df, folds)
    start, end = F.col("fold_start"), F.col("fold_end")
    if mode == "CLASSIFICATION":
        train = (F.col(feature) < start) & (F.col(label) < start)
        valid = (F.col(feature) >= start) & (F.col(feature) < end)
    else:
        train = F.col(label) < start
        valid = (F.col(label) >= start) & (F.col(label) < end)
    return rows.withColumn("role", F.when(train, "TRAIN").when(valid, "VALID")).where(F.col("role").isNotNull())


def apply_window(train: DataFrame, days: int | None, time: str = "feature_time") -> DataFrame:
    """Expanding (None) or the last ``days`` days before each fold starts."""
    if days is None:
        return train
    return train.where(F.col(time) >= F.col("fold_start") - F.make_dt_interval(F.lit(days)))


def _tail_date(df: DataFrame, by: Sequence[str], time: str, reserve) -> DataFrame:
    """Per group, the first date of the last ``reserve`` distinct dates; date lists are calendar-sized."""
    dates = df.select(*by, F.col(time).cast("date").alias("__d")).distinct()
    w = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = dates.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn(
        "__r", F.row_number().over(w.orderBy(F.col("__d").desc()))
    )
    return ranked.where(F.col("__r") == reserve(F.col("__n"))).select(*by, F.col("__d").cast("timestamp_ntz").alias("origin"))


def _too_few(what: str) -> Column:
    return F.raise_error(F.lit(f"{what}: too few dates")).cast("bigint")


def inner_split(train: DataFrame, by: Sequence[str] = ("fold",), mode: str = "CLASSIFICATION") -> DataFrame:
    """FIT and HEAD inside a training set: the last 15 percent of dates are the head, purged by label.

    A group with too few dates fails the job.
    """
    time = "feature_time" if mode == "CLASSIFICATION" else "label_time"

    def reserve(n: Column) -> Column:
        share = F.ceil(n * F.lit(0.15))
        if mode == "CLASSIFICATION":
            wanted = F.greatest(F.lit(6), share)
        else:
            wanted = F.greatest(F.lit(10), F.least(F.lit(21), share))
        kept = F.least(wanted, n - 10)
        return F.when((n >= 16 if mode == "CLASSIFICATION" else n >= 17), kept).otherwise(_too_few("inner split"))

    rows = join_on(train, _tail_date(train, list(by), time, reserve), list(by))
    origin = F.col("origin")
    fit = F.col("label_time") < origin
    if mode == "CLASSIFICATION":
        fit = fit & (F.col("feature_time") < origin)
    return rows.withColumn("part", F.when(fit, "FIT").when(F.col(time) >= origin, "HEAD")).where(F.col("part").isNotNull())


def calibration_split(
    train: DataFrame, by: Sequence[str] = ("fold",), fraction: float = 0.20, outcome: str = "label_time", target: str | None = None
) -> DataFrame:
    """FIT and CALIBRATION: the last fifth of the feature dates, at least three, purged by outcome.

    A group with too few dates fails the job, and with ``target`` also one that lacks two classes in either part.
    """

    def reserve(n: Column) -> Column:
        count = F.greatest(F.lit(3), F.ceil(n * F.lit(fraction)))
        return F.when(n > count + 3, count).otherwise(_too_few("calibration split"))

    rows = join_on(train, _tail_date(train, list(by), "feature_time", reserve), list(by))
    origin = F.col("origin")
    fit = (F.col("feature_time") < origin) & (F.col(outcome) < origin)
    rows = rows.withColumn(
        "part", F.when(fit, "FIT").when(F.col("feature_time") >= origin, "CALIBRATION")
    ).where(F.col("part").isNotNull())
    if target is None:
        return rows
    several = lambda part: F.min(F.when(F.col("part") == part, F.col(target))) < F.max(F.when(F.col("part") == part, F.col(target)))
    both = F.coalesce(several("FIT") & several("CALIBRATION"), F.lit(False)).alias("__both")
    fail = F.raise_error(F.lit(f"calibration split lacks both classes of {target}")).cast("boolean")
    checked = join_on(rows, rows.groupBy(*by).agg(both), list(by))
    return checked.where(F.when(F.col("__both"), F.lit(True)).otherwise(fail)).drop("__both")


def bridge_filter(split: DataFrame, policy: str = "WITHIN_ERA_ONLY") -> DataFrame:
    """Drop cross-era labels from training rows; validation rows are never touched."""
    if policy != "WITHIN_ERA_ONLY":
        return split
    bridge = F.col("source_target_era_transition") == C.BRIDGE_TRANSITION
    return split.where(~((F.col("role") == "TRAIN") & bridge))


def fold_tags(split: DataFrame) -> DataFrame:
    """Validation rows with training support, route coverage, support tier and route quartile."""
    cells = split.where("role = 'TRAIN'").groupBy("fold", "route", "airline").agg(F.count(F.lit(1)).alias("n"))
    routes = cells.groupBy("fold", "route").agg(F.count(F.lit(1)).alias("__a"), F.sum("n").alias("__s"))
    w = Window.partitionBy("fold")
    share = F.row_number().over(w.orderBy("__s", "route")) / F.count(F.lit(1)).over(w)
    quartile = K.right_closed_band(share, (("Q1_LOW", "Q2", "Q3", "Q4_HIGH"), (0.25, 0.5, 0.75)))
    routes = routes.withColumn("__q", quartile).drop("__s")
    out = join_on(split.where("role = 'VALID'"), cells, ["fold", "route", "airline"], "left")
    out = join_on(out, routes, ["fold", "route"], "left")
    airlines = F.coalesce("__a", F.lit(0))
    coverage = (
        F.when(airlines >= 5, "UNIVERSAL_5")
        .when(airlines == 4, "BROAD_4_5")
        .when(airlines >= 2, "MID_2_3")
        .when(airlines == 1, "SINGLE_1")
        .otherwise("UNOBSERVED_0")
    )
    support = F.coalesce("n", F.lit(0))
    return out.withColumns(
        {
            "train_route_airline_support": support,
            "route_airline_support_band": K.right_closed_band(support, C.ANCHOR_SUPPORT_BANDS),
            "coverage_band": coverage,
            "support_tier": F.when(airlines >= 4, "HIGH_SUPPORT").otherwise("LOWER_SUPPORT"),
            "route_support_quartile": F.coalesce("__q", F.lit("UNSEEN")),
        }
    ).drop("n", "__a", "__q")


# --- weights --------------------------------------------------------------------------------


def _weigh(df: DataFrame, cells: DataFrame, keys: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Join a weight per cell to the rows, scaled to mean one over the rows; ``__c`` counts the rows of a cell.

    The cell table is written once, so the rows are read twice however many steps a weight takes.
    """
    raw = cells.withColumn(name, weight)
    mean = F.greatest(F.try_divide(F.sum(F.col(name) * F.col("__c")), F.sum("__c")), F.lit(1e-12)).alias("__mean")
    scaled = with_scalars(raw, raw.agg(mean)).withColumn(name, F.col(name) / F.col("__mean"))
    return join_on(df, scaled.select(*keys, name), keys, "left")


def _cells(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"), *[F.sum(x).alias(n) for n, x in sums.items()])
    return materialise(table, "cells")


def _class_weight(cells: DataFrame, y: str) -> DataFrame:
    """Adds ``__w`` = n / (2 n_class) to a cell table that has the class among its keys."""
    counts = cells.agg(F.sum("__c").alias("__n"), F.sum(F.when(F.col(y) == 1, F.col("__c")).otherwise(0)).alias("__p"))
    own = F.when(F.col(y) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return with_scalars(cells, counts).withColumn("__w", F.try_divide(F.col("__n").cast("double"), 2 * own))


def balanced_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """n / (2 n_class), scaled to mean one."""
    return _weigh(df, _class_weight(_cells(df, [y]), y), [y], F.col("__w"), name)


def cell_weights(df: DataFrame, keys: Sequence[str], name: str = "weight") -> DataFrame:
    """Inverse cell size, scaled to mean one."""
    return _weigh(df, _cells(df, keys), keys, F.lit(1.0) / F.col("__c"), name)


def market_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Class weight times the clipped inverse root of the route count, itself scaled to mean one."""
    cells = _class_weight(_cells(df, [y, "route"]), y)
    routes = cells.groupBy("route").agg((F.lit(1.0) / F.sqrt(F.sum("__c"))).alias("__m"), F.sum("__c").alias("__r"))
    mean = routes.agg((F.sum(F.col("__m") * F.col("__r")) / F.sum("__r")).alias("__mm"))
    cells = with_scalars(join_on(cells, routes.select("route", "__m"), ["route"]), mean)
    share = F.col("__m") / F.greatest(F.col("__mm"), F.lit(1e-12))
    clipped = F.greatest(F.least(share, F.lit(3.0)), F.lit(0.35))
    return _weigh(df, cells, [y, "route"], F.col("__w") * clipped, name)


def economic_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Class weight times clipped saving over its median times transition balance, mean one."""
    saving = F.col("price_vnd") - F.col("target_price_vnd")
    floor = F.lit(25_000.0)
    gain = F.when(F.col(y) == 1, F.greatest(saving.cast("double"), floor)).otherwise(floor)
    median = exact_quantiles(df.select(gain.alias("__e")), [], "__e", {"__med": 0.5})
    ratio = F.greatest(F.least(gain / F.greatest(F.col("__med"), F.lit(1.0)), F.lit(4.0)), F.lit(0.25))
    work = with_scalars(df, materialise(median, "median")).withColumn("__ratio", ratio).drop("__med")
    cells = _class_weight(_cells(work, [y, "transition"], __s=F.col("__ratio")), y)
    sizes = cells.groupBy("transition").agg(F.sum("__c").alias("__t"))
    cells = with_scalars(join_on(cells, sizes, ["transition"]), cells.agg(F.countDistinct("transition").alias("__k")))
    factor = F.col("__w") * F.col("__n").cast("double") / (F.col("__k") * F.col("__t"))
    cells = cells.withColumn("__f", factor)
    mean = cells.agg(F.greatest(F.sum(F.col("__f") * F.col("__s")) / F.sum("__c"), F.lit(1e-12)).alias("__mean"))
    scaled = with_scalars(cells, mean).select(y, "transition", (F.col("__f") / F.col("__mean")).alias("__f"))
    out = join_on(work, scaled, [y, "transition"], "left")
    return out.withColumn(name, F.col("__f") * F.col("__ratio")).drop("__f", "__ratio")


# --- encoders -------------------------------------------------------------------------------


def fit_numeric_encoder(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Median, and mean and population deviation after median imputation, one row per column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    medians = exact_quantiles(long, ["column"], "v", {"median": 0.5})
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in numeric])).alias("column"))
    medians = names.join(medians, "column", "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    filled = long.join(medians, "column").withColumn("v", F.coalesce("v", "median"))
    stats = filled.groupBy("column").agg(F.first("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("s"))
    return stats.select("column", "median", "mean", F.when(F.col("s") > 1e-8, F.col("s")).otherwise(1.0).alias("scale"))


def fit_category_codes(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Code from one per sorted category of each column; the table has one row per distinct category.

    Codes are row numbers over range partitions, so a column of many categories is not sorted in one task.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("category"))
        for c in categorical
    ]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    numbered = row_numbers(values, ["column"], "category", [], "code")
    return numbered.select("column", "category", F.col("code").cast("int").alias("code"))


def apply_encoder(
    df: DataFrame, codes: DataFrame, numeric_state: DataFrame, categorical: Sequence[str], numeric: Sequence[str]
) -> DataFrame:
    """Codes (0 for unseen) and imputed, standardised numbers.

    The numeric state is one row per declared column, pivoted to one row; category codes join by value.
    """
    out = df
    for c in categorical:
        part = codes.where(F.col("column") == c).select(F.col("category").alias("__cat"), F.col("code").alias(f"{c}_code"))
        value = F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__"))
        out = out.withColumn("__cat", value).join(part, "__cat", "left").drop("__cat")
        out = out.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0)))
    row = numeric_state.agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(s))).alias(f"__{s}_{c}")
            for c in numeric
            for s in ("median", "mean", "scale")
        ]
    )
    out = with_scalars(out, row)
    for c in numeric:
        filled = F.coalesce(F.col(c).cast("double"), F.col(f"__median_{c}"))
        out = out.withColumn(f"{c}_z", (filled - F.col(f"__mean_{c}")) / F.col(f"__scale_{c}"))
    return out.drop(*row.columns)


def sequence_statistics(df: DataFrame, history: str = "history", mask: str = "mask", width: int = 6) -> DataFrame:
    """Mean and deviation of every state feature over unmasked steps, one row of two arrays."""
    steps = df.select(F.explode(F.filter(F.arrays_zip(history, mask), lambda s: s[mask])).alias("s")).select(
        F.col(f"s.{history}").alias("x")
    )
    mean = F.array(*[F.avg(F.col("x")[i]) for i in range(width)])
    scale = F.array(*[F.greatest(F.stddev_pop(F.col("x")[i]), F.lit(1e-6)) for i in range(width)])
    return steps.agg(mean.alias("mean"), scale.alias("scale"))


def normalise_arrays(df: DataFrame, stats: DataFrame, history: str = "history", mask: str = "mask") -> DataFrame:
    """Standardise unmasked steps; padding stays as it is."""
    row = stats.select(F.col("mean").alias("__mean"), F.col("scale").alias("__scale"))
    scaled = lambda x: F.transform(x, lambda v, i: (v - F.col("__mean")[i]) / F.col("__scale")[i])
    step = lambda x, i: F.when(F.col(mask)[i], scaled(x)).otherwise(x)
    return with_scalars(df, row).withColumn(history, F.transform(history, step)).drop("__mean", "__scale")


def rank_relevance(df: DataFrame, query: str = "query_id", price: str = "target_price_vnd") -> DataFrame:
    """Grade 0 to 4 from the averaged percentage rank of the fare; single-row queries drop out."""
    ranked = with_rank(df, [query], price, "__").where(F.col("__n") >= 2)
    grade = F.floor((F.lit(1.0) - average_rank("__") / F.col("__n")) * F.lit(5.0))
    clipped = F.greatest(F.least(grade, F.lit(4)), F.lit(0)).cast("int")
    return ranked.withColumn("relevance", clipped).drop("__before", "__ties", "__n")


def resolve_variants(adapters: DataFrame) -> DataFrame:
    """Incremental feature lists: static, then market, then direction, per adapter row."""
    static, market, direction = F.col("static"), F.col("market"), F.col("direction")
    step2 = F.array_union(static, market)
    variants = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("STATIC").alias("variant"), F.array_distinct(static).alias("features")),
        F.struct(F.lit(2).alias("step"), F.lit("STATIC_MARKET").alias("variant"), step2.alias("features")),
        F.struct(
            F.lit(3).alias("step"),
            F.lit("STATIC_MARKET_DIRECTION").alias("variant"),
            F.array_union(step2, direction).alias("features"),
        ),
    )
    return adapters.select("adapter", F.explode(variants).alias("v")).select("adapter", "v.*")
