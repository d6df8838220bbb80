import hashlib
import random
import re

import pytest

from farepanel.llm import substring
from tests.llm.helpers import EDGE, frame


def brute(rows, window):
    """Kept text, words and removed words per (id, text), with null ids before all others."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (order(i), s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone |= set(range(s, s + window))
        out.append((rows[i][0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", list(substring.COVERS))
def test_cover_aligns_all_offsets(period):
    residues = substring.COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in residues and (j + d) % period in residues for d in range(period))


@pytest.mark.parametrize("window", [1, 3, 10, 20])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 60))) for _ in range(6)]
    texts = list(EDGE)
    for _ in range(40):
        parts = [rng.choice([rng.choice(passages), " ".join(str(rng.randint(0, 999)) for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", "\x0b "]).join(parts))
    texts += ["na " * 100, texts[-1], texts[-2]]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    got = substring.remove_repeats(frame(spark, texts, ids).repartition(5), window=window).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = [(5, text), (5, text), (7, text + " tail"), (None, " ".join(map(str, range(5, 29)))), (9, text), (9, "new " + text)]
    got = substring.remove_repeats(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 20)


def test_hot_passage_in_many_slices(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"{i} {passage} {i + 1}" for i in range(300)]
    got = substring.remove_repeats(frame(spark, texts).repartition(7)).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(i, 60 if i else 0) for i in range(300)}


def test_empty_table(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_query_digest(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows, 20)}
    assert {tuple(r) for r in queries.op1_substring(spark, SF).collect()} == want
