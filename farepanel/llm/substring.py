"""Removal of word sequences that already occurred earlier in the corpus.

A difference cover D modulo v holds, for any two offsets, a shift d < v that brings both onto D. So if two
windows of ``window`` words are equal, then within their first v positions both have a cover position with the
same ``window - v + 1`` words behind it. Only these anchors are hashed and shuffled; an anchor that occurs twice
is extended to every window that may stand around it, and only those windows are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm.common import NULL_ID, id_key, ids_of, mix, sequence_hashes, shared_table, signed, slices, word_hashes, words_of

#: Perfect difference sets, period -> residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of eight words, or of as many words as there are."""
    period = max(p for p in COVERS if window - p + 1 >= min(8, window))
    return period, COVERS[period]


def cover_positions(n: int, period: int, residues: tuple[int, ...]) -> np.ndarray:
    """Cover positions below n in ascending order."""
    grid = np.arange(0, n, period)[:, None] + np.asarray(residues)[None, :]
    flat = grid.ravel()
    return flat[flat < n]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive integers in a sorted array."""
    cuts = np.flatnonzero(np.diff(values) != 1) + 1
    starts = np.r_[0, cuts]
    return values[starts], np.diff(np.r_[starts, len(values)])


def spread(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly when they need no partner."""
    return signed(mix(ids.view(np.uint64) ^ mix(at.astype(np.uint64))))


def _text_key(text: str) -> int:
    """32 bits of the text: tells rows apart that share a doc_id."""
    return int(word_hashes([text.encode("utf-8")])[0]) & 0x7FFFFFFF


def _known(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive positions per document: id, key, start, length."""
    if not len(ids):
        return ids, keys, at, at
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order]
    new = np.r_[True, (np.diff(ids) != 0) | (np.diff(keys) != 0) | (np.diff(at) != 1)]
    starts = np.flatnonzero(new)
    return ids[starts], keys[starts], at[starts], np.diff(np.r_[starts, len(ids)])


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, id, k, n): one row per anchor hash and slice. k counts cover positions; n = 0: not seen twice yet,
    -1: seen twice in its slice, > 0: a run of n anchors already known to be shared, which needs no partner."""
    period, residues = cover_for(window)
    length = window - period + 1

    def emit(batches):
        for batch in slices(batches, "text"):
            hs, owners, ks = [], [], []
            for doc, text in zip(ids_of(batch, "id"), batch.column("text").to_pylist()):
                words = word_hashes(words_of(text))
                if len(words) < window:
                    continue
                at = cover_positions(len(words) - length + 1, period, residues)
                hs.append(sequence_hashes(words, length)[at])
                owners.append(np.full(len(at), doc, np.int64))
                ks.append(np.arange(len(at)))
            if not hs:
                continue
            h, owner, k = np.concatenate(hs), np.concatenate(owners), np.concatenate(ks)
            unique, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = count[inverse] > 1
            run_id, _, run_at, run_n = _known(owner[known], np.zeros(known.sum(), np.int64), k[known])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[signed(unique), spread(run_id, run_at)]),
                    pa.array(np.r_[owner[first], run_id]),
                    pa.array(np.r_[k[first], run_at].astype(np.int32)),
                    pa.array(np.r_[np.where(count > 1, -1, 0), run_n].astype(np.int32)),
                ],
                names=["h", "id", "k", "n"],
            )

    return docs.mapInArrow(emit, "h long, id long, k int, n int")


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(id, runs): per document the runs of anchors that occur more than once in the corpus. A hash has at most one
    row per slice, so a group stays small however often its words occur."""
    same = Window.partitionBy("h")
    alone = (F.count("*").over(same) == 1)
    return (
        anchors(docs, window)
        .withColumn("alone", alone)
        .where((F.col("n") > 0) | ((F.col("n") == 0) & ~F.col("alone")))
        .select("id", F.struct("k", F.greatest("n", F.lit(1)).alias("n")).alias("run"))
        .groupBy("id")
        .agg(F.collect_list("run").alias("runs"))
    )


def _candidates(k_runs: list[dict], n_words: int, window: int) -> np.ndarray:
    """Starts of the windows that may hold a shared anchor within their first ``period`` positions."""
    period, residues = cover_for(window)
    size = len(residues)
    k = np.unique(np.concatenate([np.arange(r["k"], r["k"] + r["n"]) for r in k_runs]))
    at = period * (k // size) + np.asarray(residues)[k % size]
    starts = (at[:, None] - np.arange(period)[None, :]).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - window)])


def windows(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(h, h2, id, key, at, n): candidate windows, one row per sequence and slice; rows with n > 0 are runs of
    window starts that a smaller start in the same slice already precedes."""

    def emit(batches):
        for batch in slices(batches, "text"):
            parts = []
            for doc, text, found in zip(ids_of(batch, "id"), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = word_hashes(words_of(text))
                if len(words) < window:
                    continue
                at = _candidates(found, len(words), window)
                if len(at):
                    parts.append((sequence_hashes(words, window, 1)[at], sequence_hashes(words, window, 2)[at] & np.uint64(0x7FFFFFFF), np.full(len(at), doc), np.full(len(at), _text_key(text)), at))
            if not parts:
                continue
            h, h2, owner, key, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, owner, h2, h))
            h, h2, owner, key, at = h[order], h2[order], owner[order], key[order], at[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (owner != owner[first]) | (at != at[first])
            run_id, run_key, run_at, run_n = _known(owner[later], key[later], at[later])
            kept = ~later
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[signed(h[kept]), spread(run_id, run_at)]),
                    pa.array(np.r_[h2[kept].astype(np.int32), np.zeros(len(run_id), np.int32)]),
                    pa.array(np.r_[owner[kept], run_id]),
                    pa.array(np.r_[key[kept], run_key].astype(np.int32)),
                    pa.array(np.r_[at[kept], run_at].astype(np.int32)),
                    pa.array(np.r_[np.zeros(kept.sum(), np.int32), run_n].astype(np.int32)),
                ],
                names=["h", "h2", "id", "key", "at", "n"],
            )

    joined = docs.join(shared, "id").select("id", "text", "runs")
    return joined.mapInArrow(emit, "h long, h2 int, id long, key int, at int, n int")


def repeated_windows(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(id, key, found): per document the runs of window starts whose words also start earlier."""
    order = Window.partitionBy("h", "h2").orderBy("id", "at")
    return (
        windows(docs, shared, window)
        .withColumn("place", F.rank().over(order))
        .where((F.col("n") > 0) | (F.col("place") > 1))
        .select("id", "key", F.struct("at", F.greatest("n", F.lit(1)).alias("n")).alias("run"))
        .groupBy("id", "key")
        .agg(F.collect_list("run").alias("found"))
    )


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every word is removed that a repeated window covers.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept words are joined by one space. A window is repeated if the same words
    start earlier, at a smaller doc_id or earlier in the same document. Null and empty texts have no words and give
    an empty kept_text. A null doc_id sorts before all others. Rows that share a doc_id count as one place in this
    order: equal rows keep the same words, none removes the other; different texts under one doc_id are told apart
    by a key of the text. Other columns are ignored. An empty table gives no rows.
    """
    docs = df.select(id_key(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    whole = docs.where(F.col("text").isNotNull())
    shared = shared_table(shared_anchors(whole, window), "substring-anchors")
    found = shared_table(repeated_windows(whole, shared, window), "substring-windows")

    def rewrite(batches):
        for batch in slices(batches, "text"):
            total, gone, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = words_of(text)
                delta = np.zeros(len(words) + 1, np.int64)
                if places:
                    key = _text_key(text)
                    for place in places:
                        if place["key"] == key:
                            at, n = (np.array([r[x] for r in place["found"]], np.int64) for x in ("at", "n"))
                            np.add.at(delta, at, 1)
                            np.add.at(delta, at + n + window - 1, -1)
                lost = np.cumsum(delta)[:-1] > 0
                total.append(len(words))
                gone.append(int(lost.sum()))
                kept.append(b" ".join([w for w, x in zip(words, lost.tolist()) if not x]).decode("utf-8"))
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NULL_ID), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    places = found.groupBy("id").agg(F.collect_list(F.struct("key", "found")).alias("places"))
    return docs.join(places, "id", "left").select("id", "text", "places").mapInArrow(
        rewrite, "doc_id long, n_words long, n_removed long, kept_text string"
    )
