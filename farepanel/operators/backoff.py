"""Quantiles of the first level of a lattice that has enough rows, from one mergeable histogram.

Rows are read once, into counts per finest cell and distinct value. Coarser levels are sums of these counts: first of
the cell sizes, which decide at which level each target resolves, then of the values, but only for the cells at which
some target does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepanel.operators.scale import histogram, join_on, quantiles_of_totals, running_totals
from farepanel.session import materialise

LEVEL = "__level"
STATE = 100_000  # values of a cell whose counts one aggregation state may hold; larger cells are spread over value buckets


def _rolled(df: DataFrame, levels: Sequence[Sequence[str]], finest: Sequence[str], kept: Sequence[str | Column]) -> DataFrame:
    """Every row once per level, with the keys that the level lacks set to null."""
    kinds = dict(df.dtypes)
    structs = [
        F.struct(F.lit(i).alias(LEVEL), *[(F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(f"__{k}") for k in finest])
        for i, keys in enumerate(levels)
    ]
    return df.select(*kept, F.inline(F.array(*structs)))


def first_supported_quantiles(
    train: DataFrame,
    cells: DataFrame,
    value: str,
    levels: Mapping[str, Sequence[str]],
    probs: Mapping[str, float],
    least: Sequence[int],
    support: str = "support",
    level: str = "level",
) -> DataFrame:
    """``cells`` with the exact quantiles, rows and name of the first level that has ``least[i]`` training values.

    ``cells`` holds distinct combinations of all level keys; null keys match each other. A cell without such a level
    has nulls. Null values are not counted. A cell of up to ``STATE`` values is one aggregation state; of a larger one
    no task sees more than a value bucket. Both ways are exact.
    """
    finest = list(dict.fromkeys(c for keys in levels.values() for c in keys))
    keys_of = list(levels.values())
    rolled = [LEVEL, *[f"__{k}" for k in finest]]
    hist = materialise(histogram(train, finest, value), "backoff")
    sizes = _rolled(hist.groupBy(*finest).agg(F.sum("n").alias("n")), keys_of, finest, ["n"]).groupBy(*rolled).agg(F.sum("n").alias(support))
    enough = F.col(support) >= F.element_at(F.array(*[F.lit(n) for n in least]), F.col(LEVEL) + 1)
    places = join_on(_rolled(cells, keys_of, finest, finest), sizes.where(enough), rolled)
    first = F.min_by(F.struct(*rolled, support), LEVEL)
    resolved = materialise(places.groupBy(*finest).agg(first.alias("x")).select(*finest, "x.*"), "resolved")
    places = _rolled(hist.select(*finest).distinct(), keys_of, finest, finest)
    needed = resolved.select(*rolled, support).distinct()
    wanted = join_on(places, needed, rolled).groupBy(*finest).agg(F.collect_list(F.struct(*rolled, support)).alias("x"))
    values = join_on(hist, wanted, finest).select(value, "n", F.inline("x"))
    state = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for q in probs.values()]), F.col("n")).alias("q")
    small = values.where(F.col(support) <= STATE).groupBy(*rolled).agg(state)
    found = small.select(*rolled, *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])
    if (resolved.agg(F.max(support)).first()[0] or 0) > STATE:
        spread = histogram(values.where(F.col(support) > STATE), rolled, value, n=F.col("n"))
        totals = running_totals(spread, rolled, value, ["n"])
        found = found.unionByName(quantiles_of_totals(totals, rolled, value, probs))
    found = join_on(resolved, found, rolled)
    name = F.element_at(F.array(*[F.lit(n) for n in levels]), F.col(LEVEL) + 1)
    return join_on(cells, found.select(*finest, *probs, support, name.alias(level)), finest, "left")
