import zlib

import numpy as np
import pytest

from farepanel.llm import langid
from tests.llm.helpers import EDGE, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.where(~langid.held_out()))


def test_held_out_accuracy_and_calibration(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out())
    rows = langid.predict(docs, model).where("lang IS NOT NULL").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(rows) > 150 and np.mean(right) > 0.97
    assert abs(np.mean(right) - np.mean([r.score for r in rows])) < 0.05


def test_held_out_is_the_crc(spark):
    rows = frame(spark, ["a"] * 50, clashes=False).withColumn("held_out", langid.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_weights_are_sparse(model):
    assert (model.weights == 0).mean() > 0.5 and model.languages == ("de", "en", "es", "fr")


def test_edge_texts_and_other_columns(spark, model):
    texts = EDGE + ["12 34 %%%", "the cat and the dog were in the house of the king"]
    out = langid.predict(frame(spark, texts), model)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        known = any(c.isalpha() for c in t or "")
        assert (rows[i].lang_pred == "und") == (not known) and 0 <= rows[i].score <= 1
    other = langid.predict(frame(spark, texts, [i + 900 for i in range(len(texts))], ["z"] * len(texts), ["xx"] * len(texts)), model)
    assert [(r.lang_pred, r.score) for r in other.orderBy("doc_id").collect()] == [(rows[i].lang_pred, rows[i].score) for i in range(len(texts))]


def test_chunks_count_every_gram_once(monkeypatch):
    text = "The quick brown fox, été 漢字. " * 40
    at, counts = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    again, more = langid.features(text)
    assert at.tolist() == again.tolist() and counts.tolist() == more.tolist()
    line = len(" ".join(text.split())) + 2
    assert counts.sum() == 3 * line - 3


def test_no_labels_and_empty_table(spark):
    nothing = langid.train(frame(spark, ["a b"], langs=[None]))
    assert nothing.languages == ()
    assert [(r.lang_pred, r.score) for r in langid.predict(frame(spark, ["a b"]), nothing).collect()] == [("und", 0.0)]
    empty = langid.train(frame(spark, []))
    assert langid.predict(frame(spark, []), empty).collect() == []


def test_single_label(spark):
    one = langid.train(frame(spark, ["a b c", "d e"], langs=["en", "en"]))
    assert [r.lang_pred for r in langid.predict(frame(spark, ["x"]), one).collect()] == ["en"]


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 500)
    logits = rng.normal(size=(3, 500)) + 2 * (np.arange(3)[:, None] == labels)
    loss = lambda t: -np.log(langid.softmax(logits / t)[labels, np.arange(500)]).mean()
    t = langid.fit_temperature(logits * 10, labels) / 10
    assert loss(t) <= min(loss(t * 1.1), loss(t / 1.1))


def test_query(spark):
    from farepanel.llm import queries

    rows = queries.op9_langid(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97
