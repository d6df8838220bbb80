"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepanel.llm import bpe, divergence, exact, extract, fim, langid, minhash, packing, pii, secretscan, sharding, simhash, substring
from farepanel.llm.common import documents

SHARDS = 24


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = minhash.with_class(minhash.with_neighbours(docs), docs)
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return rows.withColumns(hexed).drop("node")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.with_offsets(digests).drop("queue", "at")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64("source"), F.lit(SHARDS))
    rows = sharding.reshard(documents(spark, sf_dir), old, SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secretscan.with_spans(docs, secretscan.dictionary(docs))
    base = F.filter("spans", lambda s: s["kind"] != secretscan.VALUE)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secretscan.BASE]
    return found.select("doc_id", *counts, F.sha2(secretscan.spans_text(base), 256).alias("base_sha256"), secretscan.spans_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring, op2_bpe, op3_minhash, op4_pii, op5_packing, op6_html, op7_simhash, op8_exact, op9_langid, op10_sharding, op11_divergence, op12_fim, op13_secrets)
} | {"pipeline": corpus_pipeline.run}

ORACLE: dict[str, str] = {
    "op1_substring": r"""
WITH words AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), starts AS (
    SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM words, unnest(range(1, len(w) - 18)) AS t(i)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM starts) WHERE place > 1
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM repeated GROUP BY doc_id
), flagged AS (
    SELECT words.doc_id, w, coalesce(g, []) AS g FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id
), kept AS (
    SELECT doc_id, w, g, [x FOR x IN range(1, len(w) + 1) IF NOT list_contains(g, x)] AS k FROM flagged
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_select(w, k), ' '), '')) AS kept_sha256 FROM kept
""",
    "op8_exact": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), ranked AS (
    SELECT doc_id, t, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
    FROM d WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
""",
    "op11_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10
), n AS (
    SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)
), p AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g)::HUGEINT AS p FROM cells WINDOW g AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL
), q AS (
    SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g)::HUGEINT AS q FROM whole WINDOW g AS (PARTITION BY lang)
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM d
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT p.lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_fim": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents
), u AS (
    SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d
), c AS (
    SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
    SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
""",
}
