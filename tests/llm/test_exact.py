import hashlib
import random
import re

from pyspark.sql import functions as F

from farepanel.llm import exact
from tests.llm.helpers import EDGE, frame


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) per row; null ids lose against others of equal length."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for n, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            kept = len(rows[i][1] or "") == len(rows[best][1] or "") and rows[i][0] == rows[best][0]
            out.append((rows[i][0], rows[best][0], len(members), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def messy_rows():
    rng = random.Random(4)
    rows = list(enumerate(EDGE)) + [(100, ""), (None, "a"), (None, None), (3, "a"), (50, "a "), (51, " a"), (50, "a ")]
    for i in range(200, 400):
        body = str(rng.randint(0, 40)) * 3
        rows.append((i, "".join(c + rng.choice(["", " ", "\n", "\x0b"]) for c in body)))
    return rows


def test_groups_against_brute_force(spark):
    rows = messy_rows()
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    got = exact.exact_groups(df, capacity=4).drop("bucket").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    buckets = exact.directory(keys, capacity=200, start=2, most=12).collect()
    assert len({r.depth for r in buckets}) >= 1 and max(r.depth for r in buckets) < 12
    # the buckets are disjoint and cover every key, none over its capacity
    hashes = [r.h & (1 << 64) - 1 for r in keys.collect()]
    sizes = {(r.prefix, r.depth): 0 for r in buckets}
    for h in hashes:
        (owner,) = [(p, d) for p, d in sizes if h >> (64 - d) == p]
        sizes[owner] += 1
    assert all(0 < n <= 200 for n in sizes.values())


def test_unsplittable_bucket_is_chained(spark):
    keys = spark.range(50).select(F.lit(7).cast("long").alias("h"))
    assert [(r.depth) for r in exact.directory(keys, capacity=10, start=1, most=3).collect()] == [3]


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    rows = messy_rows()
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    got = kept.collect()
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got]
    assert len(set(norms)) == len(norms) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    want = {(i, sha) for i, keep, _, kept_row, sha in brute(rows) if kept_row}
    assert {(r.doc_id, hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(got, norms)} == want


def test_native_plan(spark):
    plan = exact.exact_groups(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert exact.exact_groups(frame(spark, [])).collect() == []
    assert exact.drop_copies(frame(spark, [])).collect() == []
