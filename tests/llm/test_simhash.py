import itertools
import random
import re

import xxhash

from farepanel.llm import simhash
from tests.llm.helpers import EDGE, components, frame


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(x):
    return x & (1 << 64) - 1


def test_masks_cover_every_pair():
    for within in ((1 << 64) - 1, 0xFFFF0F0F00FF0001, 0b111111111111):
        masks = simhash.masks(4, within)
        positions = [i for i in range(64) if within >> i & 1]
        rng = random.Random(1)
        cases = itertools.combinations(positions, 4) if len(positions) < 20 else (rng.sample(positions, 4) for _ in range(5000))
        for case in cases:
            differ = sum(1 << i for i in case)
            assert any(not differ & m for m in masks)
        assert all(m & ~within == 0 for m in masks)
    assert all(28 <= m.bit_count() <= 36 for m in simhash.masks(4))


def test_fingerprints_and_components_against_brute_force(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(400)).split()
    texts = list(EDGE)
    for i in range(120):
        words = list(base) if i % 2 else [f"v{rng.randint(0, 50)}" for _ in range(rng.randint(1, 12))]
        if i % 2:
            words[rng.randrange(400)] = str(i)
        texts.append(" ".join(words).upper() if i % 3 == 0 else "\n".join(words))
    texts += [texts[-1], texts[-2]]
    ids = rng.sample(range(10_000), len(texts))
    rows = simhash.near_groups(frame(spark, texts, ids).repartition(5)).collect()
    fps = [plain(t) for t in texts]
    assert {r.doc_id: unsigned(r.fp) for r in rows} == dict(zip(ids, fps))
    roots = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for i, root in zip(ids, roots):
        least[root] = min(least.get(root, i), i)
    assert {r.doc_id: r.component_id for r in rows} == {i: least[root] for i, root in zip(ids, roots)}


def test_large_groups_are_covered_again(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {(unsigned(r.u), unsigned(r.v)) for r in simhash.links(points, group=40).collect()}
    assert all((u ^ v).bit_count() <= 4 for u, v in found)
    at = {f: i for i, f in enumerate(fps)}
    pairs = {frozenset((at[u], at[v])) for u, v in found}
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert components(len(fps), lambda i, j: frozenset((i, j)) in pairs) == want


def test_one_of_each_keeps_columns(spark):
    texts = ["a b c d e f g h"] * 3 + [None, "", "other words entirely here now"]
    df = frame(spark, texts, [7, 7, 9, None, 3, 4])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]


def test_null_ids_only(spark):
    rows = simhash.near_groups(frame(spark, ["a", "a", "b b b b b"], [None, None, 5])).collect()
    assert sorted(str(r.component_id) for r in rows) == ["5", "None", "None"]
    assert len(simhash.one_of_each(frame(spark, ["a", "a"], [None, None])).collect()) == 1


def test_empty_table(spark):
    assert simhash.near_groups(frame(spark, [])).collect() == []
    assert simhash.one_of_each(frame(spark, [])).collect() == []


def test_components_of_paths_and_stars(spark):
    from farepanel.llm.graph import components as spread

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.u: r.root for r in spread(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_query_whole_table(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    roots = components(len(ids), lambda i, j: (docs[ids[i]] ^ docs[ids[j]]).bit_count() <= 4)
    want = {(d, f"{docs[d]:016x}", ids[root]) for d, root in zip(ids, roots)}
    assert {tuple(r) for r in queries.op7_simhash(spark, SF).collect()} == want
