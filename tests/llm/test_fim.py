import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.llm import fim, queries
from tests.conftest import SF
from tests.llm.helpers import EDGE, frame

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if text == "" or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def messy():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\x0b", "\x1c", " ", "a", "bc", "é", "漢字", "🙂", "<", "P", ">", "<P", "<S", "<M", "M>", "\x00"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a <P> b", "<S>", "x<M>y", "< P> fine", "w " * 60_000, "é" * 70_000 + " " + "b c " * 9000, " " * 5000, "tail \n "]
    return texts


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (0, 80)])
def test_against_definition(spark, rate, spm):
    texts = messy()
    df = frame(spark, texts).withColumn("fim", F.lit("replaced"))
    out = fim.fill_in_middle(df, rate=rate, spm=spm)
    assert out.columns == df.columns and out.drop("fim").collect() == df.drop("fim").collect()
    rows = out.select("doc_id", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("restored")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, texts[r.doc_id], 42, rate, spm)
        assert r.restored == (texts[r.doc_id] or "")
    forms = {r.form for r in rows}
    assert forms == ({"plain"} if rate == 0 else {"plain", "spm", "psm"})


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "one two three four"
    rows = fim.fill_in_middle(frame(spark, [text] * 4, [None, None, 7, 7])).collect()
    assert [(r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) for r in rows] == [brute(i, text) for i in (None, None, 7, 7)]
    assert fim.fill_in_middle(frame(spark, [])).collect() == []


def test_boundaries_across_blocks(monkeypatch):
    texts = [t or "" for t in messy()][:300]
    for block in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(fim, "BLOCK", block)
        for text in texts[:60] if block < 7 else texts:
            expected = np.cumsum([0] + [len(t) for t in TOKEN.findall(text)])
            assert fim.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == expected.tolist()


def lookup(starts, firsts, slopes, residuals, rank):
    """The index read the plain way."""
    segment = max(i for i, s in enumerate(starts) if s <= rank)
    return firsts[segment] + (slopes[segment] * (rank - starts[segment]) >> fim.FRACTION) + int(residuals[rank])


@pytest.mark.parametrize("error", [1, 5, 96])
def test_segments_keep_their_bound_and_residuals_make_them_exact(error):
    rng = random.Random(error)
    shapes = [
        [0], [0, 1], [0, 10**9], [0, 10**9, 10**9 + 1, 10**9 + 2],
        np.cumsum([0] + [rng.randint(1, 9) for _ in range(20_000)]).tolist(),
        np.cumsum([0] + [rng.choice([1, 1, 1, 5000]) for _ in range(3000)]).tolist(),
        [i * i for i in range(3000)],
    ]
    for shape in shapes:
        starts, firsts, slopes, residuals = fim.fit(np.array(shape, np.int64), error)
        assert np.abs(residuals).max() <= error + 2
        assert starts[0] == 0 and starts == sorted(set(starts))
        for rank in {0, len(shape) - 1, *starts, *(rng.randrange(len(shape)) for _ in range(300))}:
            assert lookup(starts, firsts, slopes, residuals, rank) == shape[rank]
    straight = fim.fit(np.arange(0, 7 * 50_000, 7), error)
    assert len(straight[0]) == 1  # an even text is one segment


def test_index_is_small_and_fitted_once(spark):
    text = " ".join(random.Random(4).choice(["a", "word", "longer-word", "of"]) for _ in range(50_000))
    out = fim.fill_in_middle(frame(spark, [text]))
    index = out.first().fim["index"]
    assert index.n == 50_000 and len(index.residuals) == 50_001 and len(index.starts) < 500
    digests = out.select(F.sha2("fim.output", 256), F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256))
    plan = digests._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(str, map(tuple, queries.op12_fim(spark, SF).collect()))) == sorted(map(str, con.execute(queries.ORACLE["op12_fim"]).fetchall()))
