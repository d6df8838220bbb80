"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover all training texts. Weights are fitted on a bounded sample of labelled rows by
follow-the-regularised-leader (per-coordinate steps, elastic net: L1 keeps most weights at exactly zero), and a
temperature fitted on rows held out of that sample calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import MIX1, PRIME, lean, slices

BITS, ORDERS = 16, (1, 2, 3)
DIMENSIONS = 1 << BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
EPOCHS = 4
SAMPLE = 1500  # labelled rows per language, on average, that the weights are fitted on
UNKNOWN = "und"
CHUNK = 1 << 20


@dataclass(frozen=True)
class Model:
    """``languages`` in order, weights [language, feature] with the bias last, idf per feature, temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a lowered text, white space as one space, and their counts."""
    line = f" {' '.join(text.lower().split())} "
    total = np.zeros(DIMENSIONS, np.int64)
    reach = max(ORDERS) - 1
    for start in range(0, len(line), CHUNK):
        codes = np.frombuffer(line[max(0, start - reach) : start + CHUNK].encode("utf-32-le"), np.uint32).astype(np.uint64)
        skip = min(start, reach)
        gram = np.zeros(len(codes), np.uint64)
        for order in ORDERS:
            # hashes of the n-grams that end at each position
            gram = gram[: len(codes) - order + 1] if order == 1 else gram[:-1]
            gram = (gram + codes[order - 1 :] + np.uint64(order)) * PRIME
            gram = gram ^ (gram >> np.uint64(29))
            ends = gram[max(0, skip - order + 1) :]
            total += np.bincount(((ends * MIX1) >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[at]
    return values / max(float(np.sqrt((values * values).sum())), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=0))
    return e / e.sum(axis=0)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights [class, feature] after ``EPOCHS`` passes over (label, features, values); the bias is the last feature."""
    z, n = np.zeros((classes, DIMENSIONS + 1)), np.zeros((classes, DIMENSIONS + 1))

    def weights(at) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at, x = rows[i]
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            g = softmax(w @ x)
            g[label] -= 1.0
            g = g[:, None] * x[None, :]
            ns = n[:, at]
            z[:, at] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = ns + g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.05 to 20 with the smallest log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[labels, np.arange(len(labels))], 1e-12)).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Model from labelled rows; rows without a label or a letter teach nothing, and without any row the model knows
    no language. ``sample`` bounds the rows per language that the weights see, on average; ``key`` only decides
    which rows these are and which of them calibrate. One task fits this bounded sample."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("langid")).alias("draw"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches):
        found, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in slices(batches, "text", 2 << 20):
            for value in batch.column("text").to_pylist():
                if has_letter(value):
                    found[features(value)[0]] += 1
                    n += 1
        found[DIMENSIONS] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["feature", "n"])

    with lean(df.sparkSession):
        counted = rows.mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2^16 + 1 rows
    counts = np.zeros(DIMENSIONS + 1, np.int64)
    for feature, n in counted:
        counts[feature] = n
    idf = np.log((1.0 + counts[DIMENSIONS]) / (1.0 + counts[:DIMENSIONS])) + 1.0
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, DIMENSIONS + 1)), idf, 1.0)
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, min(1.0, sample / sizes[name])).otherwise(rate)
    chosen = rows.where(F.pmod("draw", F.lit(1 << 30)) < rate * (1 << 30))

    def sparse(batches):
        for batch in slices(batches, "text", 2 << 20):
            kept = [(d, languages.index(name), *features(t)) for t, name, d in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw"))) if has_letter(t)]
            yield pa.RecordBatch.from_pylist(
                [{"draw": d, "label": i, "at": at, "counts": n} for d, i, at, n in kept],
                schema=pa.schema([("draw", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]),
            )

    def fit(batches):
        rows = []
        for batch in batches:
            for d, label, at, n in zip(*(batch.column(c) for c in ("draw", "label", "at", "counts"))):
                at = np.array(at.values)
                rows.append((d.as_py(), label.as_py(), at, vector(at, np.array(n.values), idf)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        held = [r[1:] for i, r in enumerate(rows) if i % 5 == 4]
        fitted = fit_ftrl([r[1:] for i, r in enumerate(rows) if i % 5 != 4], len(languages))
        logits = np.array([fitted[:, at] @ x + fitted[:, DIMENSIONS] for _, at, x in held]).reshape(len(held), len(languages)).T
        temperature = fit_temperature(logits, np.array([r[0] for r in held], int))
        yield pa.RecordBatch.from_arrays([pa.array([fitted.astype("<f4").tobytes()], pa.binary()), pa.array([temperature])], names=["weights", "temperature"])

    sampled = chosen.mapInArrow(sparse, "draw long, label int, at array<int>, counts array<int>")
    with lean(df.sparkSession):
        blob, temperature = sampled.repartition(1).mapInArrow(fit, "weights binary, temperature double").first()
    return Model(languages, np.frombuffer(blob, "<f4").reshape(len(languages), DIMENSIONS + 1), idf, temperature)


def predict(df: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its calibrated probability; ``und`` and 0 for null texts, texts without a
    letter, and by a model without languages. Only the text decides; ties go to the first language in order."""
    name, score = into
    kept = [c for c in df.columns if c not in into]
    inside = f"__langid_{name}"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(inside))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != inside), f"`{name}` string", f"`{score}` double"])

    def run(batches):
        for batch in slices(batches, inside, 4 << 20):
            names, scores = [], []
            for value in batch.column(inside).to_pylist():
                if not model.languages or not has_letter(value):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, counts = features(value)
                p = softmax((model.weights[:, at] @ vector(at, counts, model.idf) + model.weights[:, DIMENSIONS]) / model.temperature)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(min(1.0, p[best])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, name, score])

    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the documents: CRC-32 of the id as text is divisible by 5. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
