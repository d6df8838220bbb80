"""Shrunk drop rates over a two-level hierarchy (transition, then route and airline)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators.scale import join_on, with_scalars
from farepanel.session import materialise

CELL = ("route", "airline", "transition")


def rate_cells(train: DataFrame, target: str) -> DataFrame:
    return train.groupBy(*CELL).agg(F.sum(target).cast("double").alias("k"), F.count(target).cast("double").alias("n"))


def _levels(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transition totals and the smoothed global rate, both from the cell table."""
    transitions = cells.groupBy("transition").agg(F.sum("k").alias("tk"), F.sum("n").alias("tn"))
    rate = transitions.agg(((F.sum("tk") + 0.5) / (F.sum("tn") + 1.0)).alias("global_rate"))
    return transitions, rate


def shrunk_rate(
    train: DataFrame,
    valid: DataFrame,
    target: str,
    kappas: tuple[float, float] = (C.TRANSITION_KAPPA, C.GRANULAR_KAPPA),
    name: str = "shrunk_rate",
    kappa_table: DataFrame | None = None,
) -> DataFrame:
    """(k + kappa * parent) / (n + kappa) at both levels, resolved on distinct target cells."""
    cells = rate_cells(train, target)
    transitions, rate = _levels(cells)
    if kappa_table is None:
        k1, k2 = F.lit(float(kappas[0])), F.lit(float(kappas[1]))
    else:
        rate = with_scalars(rate, kappa_table)
        k1, k2 = F.col("transition_kappa"), F.col("granular_kappa")
    wanted = with_scalars(valid.select(*CELL).distinct(), rate)
    wanted = join_on(join_on(wanted, transitions, ["transition"], "left"), cells, list(CELL), "left")
    parent = F.coalesce((F.col("tk") + k1 * F.col("global_rate")) / (F.col("tn") + k1), F.col("global_rate"))
    value = F.coalesce((F.col("k") + k2 * parent) / (F.col("n") + k2), parent)
    clipped = F.greatest(F.least(value, F.lit(1 - 1e-6)), F.lit(1e-6))
    return join_on(valid, wanted.select(*CELL, clipped.alias(name)), list(CELL))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive column: Stirling's series, below 8 through the recurrence."""
    series = lambda z: (
        (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3.0))
        + F.lit(1 / 1260) / F.pow(z, F.lit(5.0)) - F.lit(1 / 1680) / F.pow(z, F.lit(7.0)) + F.lit(1 / 1188) / F.pow(z, F.lit(9.0))
    )
    rising = reduce(lambda a, b: a * b, [x + float(i) for i in range(8)])
    return F.when(x >= 8, series(x)).otherwise(series(x + 8.0) - F.ln(rising))


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta_binomial(k: Column, n: Column, mean: Column, kappa: Column) -> Column:
    """Log likelihood of a cell without its constant."""
    mu = F.greatest(F.least(mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    a, b = mu * kappa, (1 - mu) * kappa
    return log_beta(k + a, n - k + b) - log_beta(a, b)


def estimate_kappa(cells: DataFrame, k: str, n: str, mean: str, name: str, low: float = 0.1, high: float = 100_000.0, tolerance: float = 1e-5, points: int = 33) -> DataFrame:
    """One row: the strength with the largest likelihood, to ``tolerance`` on the logarithmic scale; 100 for fewer than
    two cells.

    Equal cells are counted once. Each round evaluates a section of the range at evenly spaced points in one job and
    goes on between the neighbours of the best; only that point reaches the driver.
    """
    given = cells.where(F.col(n) > 0).groupBy(F.col(k).alias("k"), F.col(n).alias("n"), F.col(mean).alias("mu")).agg(F.count(F.lit(1)).alias("c"))
    counted = materialise(given, "cells")
    spark = cells.sparkSession
    if (counted.agg(F.sum("c")).first()[0] or 0) < 2:
        return spark.range(1).select(F.lit(100.0).alias(name))
    a, b = math.log(low), math.log(high)
    best = a
    while b - a > tolerance:
        step = (b - a) / (points - 1)
        grid = [a + i * step for i in range(points)]
        long = counted.withColumn("at", F.explode(F.array(*[F.lit(g) for g in grid])))
        value = F.sum(F.col("c") * beta_binomial(F.col("k"), F.col("n"), F.col("mu"), F.exp("at"))).alias("ll")
        best = long.groupBy("at").agg(value).agg(F.max_by("at", F.struct("ll", -F.col("at")))).first()[0]
        a, b = max(a, best - step), min(b, best + step)
    return spark.range(1).select(F.lit(math.exp(best)).alias(name))


def empirical_kappas(train: DataFrame, target: str) -> DataFrame:
    """One row: strengths of the transition level and of the granular level."""
    cells = rate_cells(train, target)
    transitions, rate = _levels(cells)
    first = estimate_kappa(with_scalars(transitions, rate), "tk", "tn", "global_rate", "transition_kappa")
    parents = with_scalars(with_scalars(transitions, rate), first).select(
        "transition",
        (
            (F.col("tk") + F.col("transition_kappa") * F.col("global_rate")) / (F.col("tn") + F.col("transition_kappa"))
        ).alias("parent"),
    )
    second = estimate_kappa(join_on(cells, parents, ["transition"]), "k", "n", "parent", "granular_kappa")
    return with_scalars(first, second)


def shrunk_rate_eb(train: DataFrame, valid: DataFrame, target: str, name: str = "shrunk_rate") -> DataFrame:
    return shrunk_rate(train, valid, target, name=name, kappa_table=empirical_kappas(train, target))
