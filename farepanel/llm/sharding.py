"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

Only shard totals reach the solver. Where a shard gives away bytes, its rows stand in a fixed order of small cells,
and the flow cuts this order into intervals, one per receiving shard, so the plan is applied by running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table

CELLS = 1024  # cells of a shard; running totals over rows stay within one


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow of all supplies into the capacities, by successive shortest augmenting paths.

    The sum of capacities must be at least that of supplies. Work grows with the number of shards only.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are too small")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    for source in range(n):
        while left[source]:
            # shortest path over residual arcs: forward i -> j at cost, back j -> i where flow can be taken back
            far = [0 if i == source else None for i in range(n)] + [None] * m
            via: list[int | None] = [None] * (n + m)
            changed = True
            while changed:
                changed = False
                for i in range(n):
                    if far[i] is None:
                        continue
                    for j in range(m):
                        if far[n + j] is None or far[i] + cost[i][j] < far[n + j]:
                            far[n + j], via[n + j], changed = far[i] + cost[i][j], i, True
                for j in range(m):
                    if far[n + j] is None:
                        continue
                    for i in range(n):
                        if flow[i][j] and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                            far[i], via[i], changed = far[n + j] - cost[i][j], n + j, True
            target = min((j for j in range(m) if room[j] and far[n + j] is not None), key=lambda j: (far[n + j], j))
            path, node = [], n + target
            while node != source:
                path.append((via[node], node))
                node = via[node]
            amount = min([left[source], room[target], *(flow[b][a - n] for a, b in path if a >= n)])
            for a, b in path:
                if a < n:
                    flow[a][b - n] += amount
                else:
                    flow[b][a - n] -= amount
            left[source] -= amount
            room[target] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan(sizes: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): intervals of every old shard's running total and where they go; what stays comes first.

    By default a byte costs 1 if it moves and nothing if it stays.
    """
    cost = cost or [[int(i != j) for j in range(len(capacity))] for i in range(len(sizes))]
    flow, cuts = min_cost_flow(sizes, capacity, cost), []
    for old, row in enumerate(flow):
        at = 0
        for new in sorted(range(len(row)), key=lambda j: (j != old, j)):
            if row[new]:
                cuts.append((old, new, at, at + row[new]))
                at += row[new]
    return cuts


def reshard(df: DataFrame, old_shard: Column, shards: int, doc_id: str = "doc_id", text: str = "text", old_shards: int | None = None, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot): the placement of every row by equal capacities in bytes.

    A row's size is the UTF-8 bytes of its text plus 8; null counts as no text, with CRC 0. ``old_shard`` is an
    expression over ``df`` from 0 to ``old_shards`` - 1. A row goes where the middle of its bytes falls, so every cut
    of the plan moves a shard's total by at most half a row. Slots count from 0 in every shard without gaps. Rows of
    one cell are ordered by id, CRC and size, so repeated rows may trade places but never change a total. Null ids
    are ids of their own. An empty table gives no rows.
    """
    olds = old_shards or shards
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    rows = shared_table(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int")), "shard-rows")
    totals = shared_table(rows.groupBy("old_shard", "cell").agg(F.sum("size").alias("bytes")), "shard-cells")  # at most olds x cells rows
    sizes = {r[0]: r[1] for r in totals.groupBy("old_shard").agg(F.sum("bytes")).collect()}  # one number per old shard
    cuts = plan([sizes.get(i, 0) for i in range(olds)], equal_capacities(sum(sizes.values()), shards))
    before = Window.partitionBy("old_shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    within = Window.partitionBy("old_shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["old_shard", "cell"]).withColumn("middle", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.expr("size div 2"))
    target = F.lit(None).cast("int")
    for old, new, low, high in cuts:  # at most old + new shards - 1 intervals
        target = F.when((F.col("old_shard") == old) & (F.col("middle") >= low) & (F.col("middle") < high), new).otherwise(target)
    placed = shared_table(placed.withColumn("shard", target).drop("start", "middle"), "shard-placed")
    pieces = placed.groupBy("shard", "old_shard", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("old_shard", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.select("shard", "old_shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "old_shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(first, ["shard", "old_shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))


def rewrite(df: DataFrame, placement: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", old_shard: Column | None = None) -> DataFrame:
    """Write the rows of every shard that gains or loses some, one folder per shard, and return the affected shards.

    A row is known by its id, the CRC and size of its text, and its number among rows that share all three, so every
    row is written once and repeated ids are rows like others. Give the ``old_shard`` of the placement if rows may be
    alike in these but not in other columns: then they trade places within their old shard only. Columns named shard or slot are replaced. Shards whose
    rows all stay are not written: their old files remain valid.
    """
    moved = placement.where("shard <> old_shard")
    affected = moved.select(F.col("shard").alias("s")).unionByName(moved.select(F.col("old_shard").alias("s"))).distinct()
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    key = [F.col(f"`{doc_id}`").cast("long").alias("__id"), F.crc32(content).alias("__crc"), (F.octet_length(content) + 8).cast("long").alias("__size")]
    key.append((F.lit(0) if old_shard is None else old_shard.cast("int")).alias("__old"))
    names = ("__id", "__crc", "__size", "__old")
    same = Window.partitionBy(*names)  # repeats of one row only
    rows = df.drop("shard", "slot").select("*", *key).withColumn("__n", F.row_number().over(same.orderBy(F.lit(0))))
    target = placement.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), (F.lit(0) if old_shard is None else F.col("old_shard")).alias("__old"), "shard", "slot")
    target = target.withColumn("__n", F.row_number().over(same.orderBy("shard", "slot")))
    target = target.select(*[F.col(c).alias(f"{c}_of") for c in (*names, "__n")], "shard", "slot")
    target = target.join(F.broadcast(affected), F.col("shard") == F.col("s")).drop("s")
    met = F.lit(True)
    for c in (*names, "__n"):
        met &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    joined = rows.join(target, met).drop(*[f"{c}{end}" for c in (*names, "__n") for end in ("", "_of")])
    joined.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return affected
