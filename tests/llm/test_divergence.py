import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from farepanel.llm import divergence, queries
from tests.conftest import SF
from tests.llm.helpers import EDGE, frame


def brute(rows, least, top):
    """Every pair and term by the definition, with the whole vocabulary laid out for every source."""
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = share(own)
        whole = share(sum((c for (at, _), c in counts.items() if at == lang), Counter()))
        pairs = [(-sum(gap(p[t], q[t]) for t in kept), other) for (at, other), c in counts.items() if at == lang and other != source for q in [share(c)]]
        terms = [(-gap(p[t], whole[t]), t) for t in kept if own[t] and p[t] > whole[t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def messy():
    rng = random.Random(8)
    words = ["Alpha", "beta", "été", "ÉTÉ", "x1y", "漢字", "İ", "don't", "zZ", "🙂", "q"]
    texts = EDGE + [" ".join(rng.choice(words[: rng.randint(1, 11)]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += ["1 2 3 !"] * 2
    langs = [rng.choice(["en", "de", "", None]) for _ in texts[:-2]] + ["nothing kept"] * 2
    sources = [rng.choice(["a", "b", "ç", "", None, "only once"]) for _ in texts[:-2]] + ["a", "b"]
    return texts, langs, sources


def test_against_definition(spark):
    texts, langs, sources = messy()
    df = frame(spark, texts, sources=sources, langs=langs).repartition(6)
    for least, top in ((10, 10), (1, 3)):
        got = sorted(tuple(r) for r in divergence.divergences(df, least=least, top=top).collect())
        assert got == brute(zip(texts, langs, sources), least, top)
    assert ("nothing kept", "a", "pair", "b", 0, 1) in brute(zip(texts, langs, sources), 10, 10)


def test_repeated_rows_empty_table_and_one_source(spark):
    assert divergence.divergences(frame(spark, [])).collect() == []
    rows = divergence.divergences(frame(spark, ["word word"] * 12, [1] * 12)).collect()
    assert rows == []  # a single source uses no term more than its language does, and has no partner


def batch(texts, sources):
    columns = [pa.array([t.encode() for t in texts], pa.binary()), pa.array(["en"] * len(texts)), pa.array(sources)]
    return pa.RecordBatch.from_arrays(columns, names=["text", "lang", "source"])


def test_stripes_handed_on_early_add_up():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40)) for _ in range(60)]
    sources = [rng.choice("xyz") for _ in texts]

    def total(room):
        docs, counts = Counter(), Counter()
        batches = list(divergence.fold([batch(texts[:30], sources[:30]), batch(texts[30:], sources[30:])], room))
        for row in pa.Table.from_batches(batches).to_pylist():
            docs[row["term"]] += row["docs"]
            for s, n in zip(row["sources"], row["counts"]):
                counts[row["term"], s] += n
        return docs, counts, sum(b.num_rows for b in batches)

    whole, early = total(10**6), total(5)
    assert whole[:2] == early[:2] and early[2] > whole[2]
    assert whole[0][""] == 60


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = ("abc défghijklmnop  q" * 5 + "ZZ").encode()
    assert sum(divergence.terms_of(text), []) == divergence.TERM.findall(text.lower())


def test_pairs_settle_and_hand_on_alike():
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        names = sorted(rng.sample("abcdefghij", rng.randint(2, 9)))
        rows.append({"lang": rng.choice(["en", "de"]), "sources": names, "p": [rng.randint(1, 10**9 + 1) for _ in names], "zero": [ord(n) * 1000 for n in names]})
    given = pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), ("p", pa.list_(pa.int64())), ("zero", pa.list_(pa.int64()))]))
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    expected = Counter()
    for r in rows:
        for i, a in enumerate(r["sources"]):
            for j in range(i + 1, len(r["sources"])):
                p, q, y, z = r["p"][i], r["p"][j], r["zero"][i], r["zero"][j]
                expected[r["lang"], a, r["sources"][j]] += gap(p, q) - gap(p, z) - gap(y, q) + gap(y, z)
    for room in (10**6, 20):
        got = Counter()
        for out in divergence.fold_pairs([given.slice(0, 90), given.slice(90)], room):
            for r in out.to_pylist():
                got[r["lang"], r["a"], r["b"]] += r["value"]
        assert got == expected


def test_counts_beyond_a_long_stay_exact(spark):
    n, total = 7 * 10**12, 9 * 10**12
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * n // total


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op11_divergence(spark, SF).collect()) == sorted(con.execute(queries.ORACLE["op11_divergence"]).fetchall())


def test_one_exchange_carries_stripes(spark):
    plan = divergence.merged_stripes(frame(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
