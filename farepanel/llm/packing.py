"""Packing of tokenised documents into windows of fixed length with a controlled mixture of sources.

Deficit round-robin gives every source queue a credit of ``length`` x share tokens per window and carries what it
could not spend. With token-sized quanta the credit spent before any point has a closed form: token t of a queue of
weight w is due at time (2 t + 1) / (2 w), windows take tokens in the order of these times, and a queue's carried
deficit never exceeds a token by more than rounding. So the window of a token follows from counts alone, and every
partition continues where the one before it stopped, without talking to it.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm import common
from farepanel.llm.common import WordCache, shared_table, slices

LENGTH, END_ID = 4096, 2
SHARES = 1 << 16  # resolution of the mixture
QUEUES = 1024  # queues of their own; smaller sources share one more
MARKS = ".,!%&*$#|"  # closing marks of words; they and letters are never in one token


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use for bytes: printable ones stand for themselves, the others
    follow from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of words between blanks, remembered for words and, fewer, for their stems without closing marks. Ids are
    kept as little-endian bytes, so that those of a text are one join."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.added = load_tokenizer(path)
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kind = "H" if self.code == "<u2" else "I"
        self.letters = byte_letters()
        self.words, self.stems = WordCache(800_000), WordCache(20_000)

    def encode(self, piece: str) -> bytes:
        """Ids of one piece: lower letters in normal form are one unit for the merges, all else is encoded whole."""
        if piece.isalpha() and piece == piece.lower() and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
            units = piece.encode("utf-8").decode("latin-1").translate(self.letters)
            return pack_ids(self.kind, [t.id for t in self.tokenizer.model.tokenize(units)])
        return pack_ids(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def stem(self, piece: str) -> bytes:
        found = self.stems.new.get(piece)
        if found is None:
            found = self.stems.older(piece)
            if found is None:
                found = self.encode(piece)
            if len(piece) <= 48:
                self.stems.put(piece, found)
        return found

    def word(self, word: str) -> bytes:
        """Ids of a word that was not used lately. A letter and a closing mark never share a token."""
        found = self.words.older(word)
        if found is None:
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and stem[-1].lower().isalpha():
                found = self.stem(stem) + self.stem(word[len(stem) :])
            else:
                found = self.stem(word)
        if len(word) <= 48:
            self.words.put(word, found)
        return found

    def text(self, text: str | None) -> bytes:
        """Ids as ``encode(text, add_special_tokens=False)`` gives them; a text with an added token's string, or with
        white space on which Python and the tokenizer disagree, is encoded whole."""
        if not text:
            return b""
        if any(a in text for a in self.added) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return pack_ids(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids)
        # the tokenizer lowers letters one by one, Python the final sigma by its place
        words = (text if "\u03a3" in text else text.lower()).split()
        found = list(map(self.words.new.get, words))
        if None in found:
            found = [self.word(w) if x is None else x for w, x in zip(words, found)]
        return b"".join(found)


def pack_ids(kind: str, ids: list[int]) -> bytes:
    out = array(kind, ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def remembered(path: str) -> WordIds:
    words = common.remembered("packing")
    if path not in words:
        words[path] = WordIds(path)
    return words[path]


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    words = remembered(path)
    return [np.frombuffer(words.text(t), words.code) for t in texts]


def tokenised(df: DataFrame, path: str, doc_id: str, text: str, source: str) -> DataFrame:
    """(part, source, before, doc_id, n, ids): ids of every row as little-endian bytes, two per id if the vocabulary
    allows, and the tokens of its source that precede it in its input partition. Nothing is shuffled."""

    def run(batches):
        part, sums, words = TaskContext.get().partitionId(), {}, remembered(path)
        end = pack_ids(words.kind, [END_ID])
        for batch in slices(batches, "text", 2 << 20, "packing"):
            ids = [words.text(t) + end for t in batch.column("text").to_pylist()]
            lengths, before = [len(x) // len(end) for x in ids], []
            for name, n in zip(batch.column("source").to_pylist(), lengths):
                before.append(sums.get(name, 0))
                sums[name] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column("source"), pa.array(before, pa.int64()), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "source", "before", "doc_id", "n", "ids"],
            )

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{source}`").cast("string").alias("source"))
    return rows.mapInArrow(run, "part int, source string, before long, doc_id long, n long, ids binary")


class Mixture:
    """Queues in a fixed order with their totals and integer weights; ``rank`` places a token among all tokens."""

    def __init__(self, totals: list[int], weights: list[int]) -> None:
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.int64)

    def rank(self, queue: np.ndarray, t: np.ndarray) -> np.ndarray:
        """How many tokens are due before tokens ``t`` of the queues: earlier times, or equal ones of earlier queues."""
        own, total = self.weights[queue], np.zeros(len(t), np.int64)
        for other, (most, weight) in enumerate(zip(self.totals, self.weights)):
            # times (2 s + 1) / (2 weight) before (2 t + 1) / (2 own)
            whole, part = np.divmod((2 * t + 1) * weight - own, 2 * own)
            due = np.clip(whole + np.where(other < queue, 1, part > 0), 0, most)
            total += np.where(other == queue, t, due)
        return total

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Pieces of runs of n > 0 tokens from ``start``: run, window, first token within the run, tokens."""
        stop = start + n
        first, last = self.rank(queue, start) // length, self.rank(queue, stop - 1) // length
        count = last - first + 1
        run = np.repeat(np.arange(len(n)), count)
        ends = np.cumsum(count)
        window = np.arange(len(run)) - np.repeat(ends - count, count) + first[run]
        head, tail = window == first[run], window == last[run]
        # the first token that is due in a window, by bisection for all windows at once
        owner, edge = queue[run][~head], window[~head] * length
        low, high = start[run][~head], stop[run][~head]
        while (low < high).any():
            middle = (low + high) // 2
            late = self.rank(owner, np.minimum(middle, high - (low < high))) >= edge
            high, low = np.where(late & (low < high), middle, high), np.where(~late & (low < high), middle + 1, low)
        begins, stops = start[run], stop[run]
        begins[~head], stops[~tail] = low, low
        some = stops > begins
        return run[some], window[some], (begins - start[run])[some], (stops - begins)[some]


def cut_pieces(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, weights: dict | None = None, queues: int = QUEUES
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, queue, at): the pieces of all windows; ``at`` is the place in the queue.

    ``ids`` are little-endian unsigned 32-bit integers. A document is its ids and one end id; null and empty texts are the end id alone. Every window but the last has
    exactly ``length`` tokens, so only the last is padded. ``weights`` gives target shares by source (missing ones
    count 1); by default they are the sources' shares of all tokens, so that all queues end together; a queue that
    ends early leaves its share to the others. The largest ``queues`` sources have queues of their own, all others
    share one; a null source is a source. Order within a queue is that of the input. Repeated rows and ids are packed
    like any others, other columns are ignored, and an empty table gives no rows.
    """
    rows = shared_table(tokenised(df, path, doc_id, text, source), "packing-ids")
    sums = shared_table(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    largest = [(r[0], r[1]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(queues).collect()]
    total = sums.agg(F.sum("n")).first()[0] or 0
    rest = total - sum(n for _, n in largest)
    totals = [n for _, n in largest] + [rest] * bool(rest)
    shares = [weights.get(s, 1) for s, _ in largest] + [1] * bool(rest) if weights else totals
    mixture = Mixture(totals, [max(1, round(SHARES * x / max(1, sum(shares)))) for x in shares])
    names = df.sparkSession.createDataFrame([(s, i, True) for i, (s, _) in enumerate(largest)], "source string, queue int, own boolean")
    # at most ``queues`` names
    known = sums.join(F.broadcast(names), sums["source"].eqNullSafe(names["source"]), "left").select("part", sums["source"], "n", F.coalesce("queue", F.lit(len(largest))).alias("queue"))
    ahead = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", "first")
    offsets = shared_table(offsets, "packing-offsets")  # parts x sources rows; its size decides the join

    def cut(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                queue, at, n = (part.column(c).to_numpy().astype(np.int64) for c in ("queue", "at", "n"))
                run, window, start, size = mixture.pieces(queue, at, n, length)
                blobs = part.column("ids").to_pylist()
                values = [np.frombuffer(b, f"<u{len(b) // k}") for b, k in zip(blobs, n.tolist())]
                pieces = [values[i][a : a + k].astype("<u4").tobytes() for i, a, k in zip(run.tolist(), start.tolist(), size.tolist())]
                row = pa.array(run)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(row), pa.array(start), pa.array(size), pa.array(pieces, pa.binary()),
                        part.column("n").take(row), pa.array(window), part.column("queue").take(row), pa.array(at[run] + start),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "queue", "at"],
                )

    placed = rows.join(offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("doc_id", "n", "ids", "queue", (F.col("first") + F.col("before")).alias("at"))
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, queue int, at long")


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds the place of every piece in its window: queues in order, each queue's tokens in order. A window has at
    most as many pieces as tokens."""
    ahead = Window.partitionBy("sequence_id").orderBy("queue", "at").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))


def pack(df: DataFrame, path: str, **options) -> DataFrame:
    """The pieces of ``cut_pieces`` with their ids and their offsets in the windows."""
    return with_offsets(cut_pieces(df, path, **options))
