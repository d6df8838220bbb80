import itertools
import random
import zlib

from pyspark.sql import functions as F

from farepanel.llm import sharding
from tests.llm.helpers import EDGE, frame


def cheapest(supply, capacity, cost):
    """Smallest cost over all integer flows of a tiny problem."""
    best = None
    ways = [[w for w in itertools.product(range(s + 1), repeat=len(capacity)) if sum(w) == s] for s in supply]
    for rows in itertools.product(*ways):
        if all(sum(r[j] for r in rows) <= capacity[j] for j in range(len(capacity))):
            total = sum(rows[i][j] * cost[i][j] for i in range(len(supply)) for j in range(len(capacity)))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        supply = [rng.randint(0, 4) for _ in range(3)]
        capacity = [rng.randint(0, 5) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(3))
        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == cheapest(supply, capacity, cost)


def test_plan_moves_only_the_surplus():
    sizes = [100, 0, 20, 0]
    cuts = sharding.plan(sizes, sharding.equal_capacities(120, 4))
    assert sum(b - a for old, new, a, b in cuts if old != new) == 70
    for old, size in enumerate(sizes):
        own = sorted((a, b) for o, _, a, b in cuts if o == old)
        assert [a for a, _ in own] == [0, *(b for _, b in own)][: len(own)] and (own[-1][1] if own else 0) == size


def test_placement(spark):
    rng = random.Random(2)
    texts = EDGE + ["z" * rng.randint(0, 300) for _ in range(600)] + ["same"] * 100
    ids = list(range(len(texts) - 2)) + [None, 5]
    sources = [rng.choice(["hot"] * 6 + ["a", "b", None]) for _ in texts]
    old = F.pmod(F.hash("source"), F.lit(6))
    rows = sharding.reshard(frame(spark, texts, ids, sources).repartition(5), old, 6, cells=16).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    totals, before = [0] * 6, [0] * 6
    for r in rows:
        totals[r.shard] += r.size
        before[r.old_shard] += r.size
    mean, largest = sum(totals) / 6, max(r.size for r in rows)
    assert all(abs(t - mean) <= 3 * largest for t in totals)
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    least = sum(max(0, b - c) for b, c in zip(before, sharding.equal_capacities(sum(before), 6)))
    assert abs(moved - least) <= 6 * largest
    for shard in range(6):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_fewer_and_more_shards(spark):
    df = frame(spark, ["t" * i for i in range(60)])
    for olds, news in ((3, 8), (8, 3)):
        rows = sharding.reshard(df, F.pmod(F.col("doc_id"), F.lit(olds)), news, old_shards=olds).collect()
        assert {r.shard for r in rows} == set(range(news)) and len(rows) == 60


def test_rewrite_writes_affected_shards_only(spark, tmp_path):
    df = frame(spark, ["t" * 50] * 40, sources=["a"] * 40)
    old = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 35, 1).otherwise(2)
    placement = sharding.reshard(df, old, 3, cells=8)
    affected = {r.s for r in sharding.rewrite(df, placement, str(tmp_path / "out")).collect()}
    moved = {(r.shard, r.old_shard) for r in placement.collect() if r.shard != r.old_shard}
    assert affected == {s for pair in moved for s in pair}
    written = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in placement.collect() if r.shard in affected}
    assert {(r.doc_id, r.shard) for r in written.collect()} == want and set(df.columns) <= set(written.columns)


def test_rewrite_of_repeated_ids(spark, tmp_path):
    df = frame(spark, ["t" * 50, "u" * 50] * 20, ids=[7, None, 7, 7] * 10, sources=["a", "b", "c", "d"] * 10)
    old = F.when(F.col("source") == "a", 0).otherwise(1)
    placement = sharding.reshard(df, old, 2, cells=8)
    assert {r.s for r in sharding.rewrite(df, placement, str(tmp_path / "out"), old_shard=old).collect()} == {0, 1}
    written = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda t: sorted((str(r.doc_id), r.text, r.source) for r in t.collect())
    assert rows(written) == rows(df)
    assert sorted((r.shard, r.slot) for r in written.collect()) == sorted((r.shard, r.slot) for r in placement.collect())


def test_empty_table(spark):
    assert sharding.reshard(frame(spark, []), F.lit(0), 24).collect() == []


def test_query_totals(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, SF).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 24 for r in rows)
