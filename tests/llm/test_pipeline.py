import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from farepanel.llm import langid, packing
from farepanel.llm.common import shared_table, slices
from tests.conftest import SF
from tests.llm.helpers import EDGE, components, frame
from tests.llm.test_packing import whole
from tests.llm.test_pii import base, masked
from tests.llm.test_simhash import plain


def brute(spark, docs, rows):
    """Ids of every document that stays, by plain Python; only the trained model is shared."""
    model = langid.train(docs.where(~langid.held_out()))

    def known(text):
        if not langid.has_letter(text):
            return False
        at, n = langid.features(text)
        x = langid.vector(at, n, model.idf)
        p = langid.softmax((model.weights[:, at] @ x + model.weights[:, langid.DIMENSIONS]) / model.temperature)
        return p.max() >= corpus_pipeline.LEAST_SCORE

    rows = [(i, t) for i, t in rows if known(t)]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0, "")), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    fps = [plain(t) for _, t in rows]
    roots = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(masked(t, base(t)), add_special_tokens=False).ids + [2] for i, t in rows}


def test_whole_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert whole(corpus_pipeline.run(spark, SF).collect(), 4096) == want


def test_stages_keep_columns_and_survive_edges(spark):
    texts = EDGE + ["the house and the garden of the king was in the north"] * 3 + ["12 34"]
    docs = frame(spark, texts, clashes=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).collect() == []
        assert 0 < out.count() <= len(texts)
        wide = frame(spark, texts)
        assert set(wide.columns) == set(stage(spark, wide, SF).columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(texts)


def test_stages_hand_python_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1500).alias("text"))
    written = shared_table(texts.mapInArrow(sizes, "size long"), "sizes")
    assert written.agg(F.sum("size")).first()[0] >= 4000 * 7500
    assert written.agg(F.max("size")).first()[0] < 8 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_workers_drop_what_another_operator_remembers(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.remembered(path)
    batch = pa.RecordBatch.from_pydict({"text": ["a b", "c"]})
    assert sum(b.num_rows for b in slices([batch], "text", owner="packing")) == 2
    assert packing.remembered(path) is words
    assert sum(b.num_rows for b in slices([batch], "text")) == 2
    assert packing.remembered(path) is not words


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11))
    assert {"op1_substring", "op8_exact"} <= set(entry.oracle_sql())
