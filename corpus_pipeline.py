"""A training corpus from raw documents: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepanel.llm import exact, langid, packing, pii, simhash
from farepanel.llm.common import documents, shared_table

LEAST_SCORE = 0.5  # calibrated probability below which a language counts as unknown


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language is undetermined go; the model learns from the labelled ones."""
    model = langid.train(docs.where(~langid.held_out()))
    predicted = langid.predict(docs, model, into=("__lang", "__score"))
    known = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    return predicted.where(known).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the longest original stays, then the smallest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each SimHash component stays, the smallest id."""
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: windows of 4096 tokens; one row per piece with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("queue", "at")


STAGES = [
    ("language", keep_known_languages),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_windows),
]
#: SQL can express neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each writes Parquet that the next one reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
