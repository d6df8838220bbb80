import hashlib
import random

import numpy as np

from farepanel.llm import minhash
from tests.llm.helpers import EDGE, components, frame


def sets(text):
    words = (text or "").split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts_of(n, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_neighbours_across_ranges(spark):
    texts = EDGE + texts_of(60, 1) + [EDGE[5]]
    ids = random.Random(2).sample(range(-500, 500), len(texts))
    got = {r.doc_id: r for r in minhash.with_neighbours(frame(spark, texts, ids).repartition(4)).collect()}
    order = sorted(zip(ids, texts))
    assert set(got) == set(ids)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, row = text or "", after or "", got[i]
        k = len(text) // 4
        other = text[: len(text) - k] + after[:k]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert bytes(row.fingerprint) == minhash.signature_of(text).tobytes()
        assert bytes(row.edited_fingerprint) == minhash.signature_of(other).tobytes()
        assert abs(row.near_edited - jaccard(sets(text), sets(other))) < 0.2
        assert abs(row.near_next - jaccard(sets(text), sets(after))) < 0.2


def test_single_row_is_its_own_next(spark):
    (row,) = minhash.with_neighbours(frame(spark, ["one two three four five six seven"])).collect()
    assert row.near_next == 1.0 and row.n_chars == 33


def test_equal_and_null_ids(spark):
    rows = minhash.with_neighbours(frame(spark, ["a b c", "a b c", None, "d"], [4, 4, None, 9])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "4", "9", "None"]
    same = [bytes(r.fingerprint) for r in rows if r.doc_id == 4]
    assert same[0] == same[1]


def test_empty_table(spark):
    assert minhash.with_neighbours(frame(spark, [])).collect() == []
    assert minhash.near_classes(frame(spark, [])).collect() == []


def test_signatures_estimate_jaccard():
    rng = random.Random(4)
    errors = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
        other = words[: rng.randint(0, 300)] + [f"v{rng.randint(0, 9999)}" for _ in range(60)]
        a, b = " ".join(words), " ".join(other)
        errors.append(minhash.likeness(minhash.signature_of(a), minhash.signature_of(b)) - jaccard(sets(a), sets(b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_near_classes(spark):
    base = texts_of(12, 5)
    texts = [t for t in base for _ in range(2)]
    for i in range(1, len(texts), 2):
        words = texts[i].split()
        if len(words) > 80:
            words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts += [None, "", base[0]]
    linked = lambda i, j: jaccard(sets(texts[i]), sets(texts[j])) >= 0.8
    got = {r.doc_id: r.class_id for r in minhash.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), linked)


def templates(n, seed):
    """Texts of one template at about 0.6 to each other, and copies of some of them at 0.8 and more."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(n):
        texts.append(" ".join(base + [f"u{k}_{i}" for i in range(45)]))
        if k % 3 == 0:
            texts.append(texts[-1] + " " + " ".join(f"x{k}_{i}" for i in range(rng.choice((10, 30, 45, 60)))))
    return rng.sample(texts, len(texts))


def test_bucket_of_similar_texts(spark):
    texts = templates(240, 8)
    found = [sets(t) for t in texts]
    keys = [[minhash.signature_of(t)[4 * b : 4 * b + 4].tobytes() for b in range(32)] for t in texts]
    linked = lambda i, j: jaccard(found[i], found[j]) >= 0.8 and any(a == b for a, b in zip(keys[i], keys[j]))
    want = components(len(texts), linked)
    assert 240 <= len(set(want)) < len(texts)
    for options in ({}, {"group": 16}, {"load": 2000}):
        got = {r.doc_id: r.class_id for r in minhash.near_classes(frame(spark, texts), **options).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_pairs_that_share_little_but_the_template(spark):
    words = lambda name, n: [f"{name}_{i}" for i in range(n)]
    texts = [" ".join(words("w", 180) + words(f"p{k // 2}", 5) + words(f"u{k}", 20)) for k in range(240)]
    found = [sets(t) for t in texts]
    keys = [[minhash.signature_of(t)[4 * b : 4 * b + 4].tobytes() for b in range(32)] for t in texts]
    linked = lambda i, j: jaccard(found[i], found[j]) >= 0.8 and any(a == b for a, b in zip(keys[i], keys[j]))
    want = components(len(texts), linked)
    assert len(set(want)) == 120
    got = {r.doc_id: r.class_id for r in minhash.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_large_bucket_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(200)]
    rows = minhash.near_classes(frame(spark, texts), group=16).collect()
    assert len(rows) == 200 and {r.class_id for r in rows} == {0}


def test_query_carries_classes(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    rows = queries.op3_minhash(spark, SF).collect()
    want = minhash.near_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted(map(tuple, want))


def test_query_whole_table(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    rows = queries.op3_minhash(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == minhash.signature_of(docs[r.doc_id]).tobytes().hex() and r.n_chars == len(docs[r.doc_id])


def test_key_filter_never_loses_a_key(spark, monkeypatch):
    import numpy as np

    from farepanel.llm import common

    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in keys], "a long, b long")
    others = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    for limit, most in ((1 << 27, 0.02), (1 << 15, 1.0)):  # roomy, and far too small
        monkeypatch.setattr(common, "FILTER_BITS", limit)
        given = common.key_filter(df, "a", "b")
        assert given[0] <= limit and common.may_hold(given, keys[:, 0].copy(), keys[:, 1].copy()).all()
        assert common.may_hold(given, others[:, 0].copy(), others[:, 1].copy()).mean() <= most
    empty = common.key_filter(df.limit(0), "a", "b")
    assert not common.may_hold(empty, keys[:, 0].copy(), keys[:, 1].copy()).any()
