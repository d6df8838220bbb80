"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table, spent


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, root): the smallest node reachable from every node that has a link; nodes without links are absent.

    Every round points all larger neighbours of a node at its smallest neighbour, then all smaller ones. Minima are
    partial aggregates and are joined back, so a node with very many links needs no task of its own. A round's
    links are written to the shared folder; the driver sees only two totals, and the rounds grow with the logarithm
    of the nodes.
    """
    pairs = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = shared_table(pairs, "links")
    state = _totals(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, shared_table(small, "links")
        before, state = state, _totals(now)
        spent(last)
        if state == before:
            break
    roots = now.select("u", F.col("v").alias("root"))
    roots.table_path = now.table_path
    return roots


def _totals(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
