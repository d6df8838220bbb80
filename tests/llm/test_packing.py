import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farepanel.llm import packing
from tests.llm.helpers import EDGE, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    rng = random.Random(2)
    letters = list("aB'strevldmRE1 2  \n\t!?-\x0b\x0c\r\x1c\x85 é漢É字İſ🙂_²") + ["<|endoftext|>", " ", ".", "!!", "Σ", "́", "###", "&&&"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [t for t in EDGE if t]
    for text, ids in zip(texts, packing.token_ids(texts, PATH)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again(library):
    words = packing.WordIds(PATH)
    words.words.half = words.stems.half = 3
    text = " ".join(f"word{i % 7} other{i % 5}." for i in range(60))
    assert np.frombuffer(words.text(text), words.code).tolist() == library.encode(text, add_special_tokens=False).ids


def test_many_rare_words_stay_remembered(monkeypatch):
    words = packing.WordIds(PATH)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(150_000))
    first = words.text(text)
    monkeypatch.setattr(words, "word", lambda word: pytest.fail(f"{word} was forgotten"))
    assert words.text(text) == first


def test_ranks_and_pieces_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        totals, weights = rng.integers(1, 60, rng.integers(1, 5)).tolist(), rng.integers(1, 9, 5).tolist()
        weights = weights[: len(totals)]
        mixture, scale = packing.Mixture(totals, weights), int(np.prod(weights))
        order = sorted(((2 * t + 1) * scale // weights[q], q, t) for q in range(len(totals)) for t in range(totals[q]))
        assert all(mixture.rank(np.array([q]), np.array([t]))[0] == i for i, (_, q, t) in enumerate(order))
        queue, start, n = [], [], []
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                queue.append(q)
                start.append(at)
                n.append(int(rng.integers(1, total - at + 1)))
                at += n[-1]
        length = int(rng.integers(1, 9))
        got = {}
        for run, window, first, size in zip(*mixture.pieces(np.array(queue), np.array(start), np.array(n), length)):
            for j in range(size):
                got[(queue[run], start[run] + first + j)] = window
        assert got == {(q, t): i // length for i, (_, q, t) in enumerate(order)}


def whole(pieces, length):
    """Windows are full but the last, offsets have no gaps, and every document comes back whole."""
    windows, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    assert sorted(windows) == list(range(len(windows)))
    for w, parts in windows.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and 4 * p.length == len(p.ids) > 0
            at += p.length
        assert at == length or w == len(windows) - 1
    out = {}
    for d, parts in docs.items():
        ids = []
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == len(ids) and p.doc_tokens == sum(x.length for x in parts)
            ids += np.frombuffer(p.ids, "<u4").tolist()
        out[d] = ids
    return out


def test_every_id_once_and_mixture_in_every_window(spark, library):
    rng = random.Random(7)
    texts = EDGE + [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    sources = [rng.choice(["hot"] * 5 + ["a", "b", None]) for _ in texts]
    df = frame(spark, texts, sources=sources).repartition(6)
    pieces = packing.pack(df, PATH, length=128).collect()
    got = whole(pieces, 128)
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    tokens = Counter()
    for i, s in enumerate(sources):
        tokens[s] += len(got[i])
    total, last = sum(tokens.values()), max(p.sequence_id for p in pieces)
    seen = defaultdict(Counter)
    for p in pieces:
        seen[p.sequence_id][sources[p.doc_id]] += p.length
    for window in range(last):
        for s in tokens:
            assert abs(seen[window][s] - 128 * tokens[s] / total) <= 3


def test_given_weights_and_shared_queue(spark):
    texts, sources = ["a b c d e f g h"] * 90, ["x", "y", "z"] * 30
    pieces = packing.pack(frame(spark, texts, sources=sources), PATH, length=64, weights={"x": 3}).collect()
    whole(pieces, 64)
    first = Counter()
    for p in pieces:
        if p.sequence_id == 0:
            first[sources[p.doc_id]] += p.length
    assert abs(first["x"] - 64 * 3 / 5) <= 2
    whole(packing.pack(frame(spark, texts, sources=sources), PATH, length=64, queues=1).collect(), 64)


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []


def test_query_digests(spark, library):
    from farepanel.llm import queries
    from tests.conftest import SF

    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_packing(spark, SF).collect()
    assert Counter({d: sum(r.length for r in rows if r.doc_id == d) for d in docs}) == Counter({d: len(i) for d, i in docs.items()})
    for r in rows:
        part = docs[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
