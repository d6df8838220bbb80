import hashlib
import random
import re

from pyspark.sql import functions as F

from farepanel.llm import pii
from tests.llm.helpers import EDGE, frame


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """Base spans by plain regular expressions: (start, order, end, kind)."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def merged(spans):
    out = []
    for s, _, e, kind in spans:
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, kind])
    return out


def masked(text, spans):
    for s, e, kind in reversed(merged(spans)):
        text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
    return text


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["1", "2", "40", "255", "256", "007", ".", ".", "-", " ", "(", ")", "+", "@", "a", "b.c", "_", "%", "é", "🙂", "4532015112830366", "\n", "+1 (743) 555-3824", "10.0.0.1"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += ["a@" + "b." * 5000, "1" * 6_000, "x" * 6_000 + "@", "a.b@c.d_e@f.g@h.i", "1.2.3.4.5.6.7.8.9", "+" + "1" * 6_000, "12 " * 30_000]
    rows = pii.with_spans(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.start, s["rank"], s.end, s.kind) for s in r.spans if s["rank"] < 4] == base(r.text or "")


def test_checksums_and_context(spark):
    cases = {
        "Pay IBAN DE89 3704 0044 0532 0130 00 now": ["iban"],
        "DE89370400440532013000.": ["iban"],
        "DE89370400440532013001": [],
        "my ssn is 123-45-6789": ["ssn"],
        "part 123-45-6789": [],
        "ssn 000-45-6789": [],
        "call 555-123-4567": ["local_phone"],
        "code 555-123-4567": [],
        "call +1 (743) 555-3824": ["phone"],
    }
    rows = pii.with_spans(frame(spark, list(cases))).collect()
    assert {r.text: [s.kind for s in r.spans] for r in rows} == cases
    scores = {r.text: [s.score for s in r.spans] for r in pii.with_spans(frame(spark, ["x 10.0.0.1", "server 10.0.0.1"])).collect()}
    assert scores["server 10.0.0.1"] > scores["x 10.0.0.1"]


def test_redaction(spark):
    texts = EDGE + ["mail a@b.co, a@b.co or 4532015112830366!", "4532015112830366@b.co 10.0.0.1"]
    df = frame(spark, texts)
    out = pii.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        text = texts[r.doc_id]
        assert r.text == (None if text is None else masked(text, base(text)))


def test_native_plan(spark):
    plan = pii.with_spans(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_and_repeated_rows(spark):
    assert pii.with_spans(frame(spark, [])).collect() == []
    rows = pii.with_spans(frame(spark, ["a@b.co", "a@b.co"], [1, 1])).collect()
    assert rows[0].spans == rows[1].spans and len(rows[0].spans) == 1


def test_query_digest(spark):
    from farepanel.llm import queries
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, SF).collect():
        spans = base(docs[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in spans) for k in pii.BASE)
