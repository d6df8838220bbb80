import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from farepanel.llm import bpe
from tests.llm.helpers import EDGE, frame

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH)[0], special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = list("ab'strevldmRE1 2  \n\t!?- 　é漢字́🙂\x85\x1c_²") + ["'ll", " '", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300 if i % 10 == 0 else 15))) for i in range(n)]


def test_boundaries_equal_the_pattern():
    texts = random_texts(4000, 1)
    for text, starts in zip(texts, bpe.token_starts(texts)):
        assert starts.tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_scan_state_crosses_blocks():
    for n in (bpe.BLOCK - 1, bpe.BLOCK, bpe.BLOCK + 1, 3 * bpe.BLOCK):
        text = "a" * n + "'s" + " " * n + "b"
        assert bpe.token_starts([text])[0].tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_long_pieces_merge_like_short_ones(library):
    rng = random.Random(3)
    ranks = bpe.load_ranks(PATH)[0]
    for n in (5, 31, 33, 400):
        piece = "".join(rng.choice("abcdetion") for _ in range(n))
        want = library.encode_ordinary(piece)
        assert bpe.merge(piece.encode(), ranks) == want
        assert piece.encode() in ranks or bpe._merge_long(piece.encode(), ranks) == bpe._merge_short(piece.encode(), ranks) == want


def test_encode_and_decode(spark, library):
    texts = EDGE + random_texts(300, 2) + ["z" * 100_000, EDGE[5], "<|endoftext|>"]
    rows = bpe.decode(bpe.encode(frame(spark, texts), PATH), PATH).collect()
    assert len(rows) == len(texts)
    tokens = bpe.load_ranks(PATH)[1]
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode("utf-8")
        for i, at in zip(row.ids, row.offsets):
            assert text.encode("utf-8")[at : at + len(tokens[i])] == tokens[i]


def test_round_trip_equals_encoding_and_decoding(spark):
    df = frame(spark, EDGE + random_texts(300, 6), clashes=False).repartition(3)
    both = bpe.decode(bpe.encode(df, PATH), PATH).select("doc_id", "ids", "decoded").orderBy("doc_id").collect()
    assert bpe.round_trip(df, PATH).orderBy("doc_id").collect() == both


def test_null_ids_unknown_ids_and_other_columns(spark):
    df = spark.createDataFrame([(1, [65, 66], "x"), (2, None, "y"), (3, [], None)], "doc_id long, ids array<int>, more string")
    tokens = bpe.load_ranks(PATH)[1]
    rows = bpe.decode(df, PATH).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in rows] == [tokens[65] + tokens[66], b"", b""] and [r.more for r in rows] == ["x", "y", None]
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([([10**8],)], "ids array<int>"), PATH).collect()


def test_repeated_rows_and_empty_table(spark):
    rows = bpe.encode(frame(spark, ["a b", "a b"], [1, None]), PATH).collect()
    assert rows[0].ids == rows[1].ids and {r.doc_id for r in rows} == {1, None}
    assert bpe.decode(bpe.encode(frame(spark, []), PATH), PATH).collect() == []


def test_query_equals_library(spark, library):
    from farepanel.llm import queries
    from tests.conftest import SF

    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert {tuple(r) for r in queries.op2_bpe(spark, SF).collect()} == want
