"""Byte-level BPE by a rank file: encoding with token offsets, and decoding.

Pre-tokenisation works on whole slices of text at once. Every code point becomes a symbol (its class, plus what
the next one or two code points decide), a symbol is a transition between a few states, and since composing
transitions is associative, the state before every code point comes from a blocked scan: compose each block, chain
the blocks, replay them side by side. A table over (state, symbol) then says where a token starts.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import WordCache, slices

# Symbols. END_ marks the last white space of a run with a non-space behind it.
LETTER, NUMBER, OTHER, SPACE, BLANK, END_SPACE, END_BLANK, QUOTE1, QUOTE2, BREAK = range(10)
# States: what stands before. MORE1, MORE2: one or two letters of a contraction are still to come.
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, IN_BLANK, MORE1, MORE2 = range(8)
#: White space of the pattern's \\s, and the contractions it takes first.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
BLOCK = 128
CACHE_LENGTH = 48
NEVER = 1 << 31


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here), both over [symbol, state]."""
    to, starts = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    plain = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    for state in range(8):
        for symbol in range(10):
            if symbol == BREAK:
                to[symbol, state], starts[symbol, state] = START, True
            elif state in (MORE1, MORE2):
                to[symbol, state] = START if state == MORE1 else MORE1
            elif symbol in plain:
                to[symbol, state] = plain[symbol]
                starts[symbol, state] = state not in (plain[symbol], IN_SPACE)
            elif symbol in (QUOTE1, QUOTE2):
                inside = state in (IN_OTHER, IN_SPACE)
                to[symbol, state] = IN_OTHER if inside else MORE1 if symbol == QUOTE1 else MORE2
                starts[symbol, state] = not inside
            else:
                to[symbol, state] = IN_SPACE if symbol in (SPACE, END_SPACE) else IN_BLANK
                starts[symbol, state] = state not in (IN_SPACE, IN_BLANK) or symbol in (END_SPACE, END_BLANK)
    return to, starts


NEXT, STARTS = _tables()


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kinds[code] = LETTER if first == "L" else NUMBER
    kinds[list(WHITE_SPACE)] = BLANK
    kinds[32] = SPACE
    return kinds


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``breaks`` marks the positions that stand between two texts."""
    kinds = code_classes()[codes]
    kinds[breaks] = BREAK
    white = (kinds == SPACE) | (kinds == BLANK)
    follows = np.r_[kinds[1:], BREAK]
    last = white & ~np.r_[white[1:], True] & (follows != BREAK)
    kinds[last] += END_SPACE - SPACE
    for at in np.flatnonzero(codes == ord("'")).tolist():
        if kinds[at] == OTHER:
            ahead = "".join(chr(c) if kinds[at + 1 + i] != BREAK else "\0" for i, c in enumerate(codes[at + 1 : at + 3].tolist()))
            if ahead[:1] and ahead[0] in ONE_LETTER:
                kinds[at] = QUOTE1
            elif ahead in TWO_LETTERS:
                kinds[at] = QUOTE2
    return kinds


def states_before(kinds: np.ndarray) -> np.ndarray:
    """State before every symbol, by a blocked scan over transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, BREAK, np.uint8)
    padded[:n] = kinds
    # a step of the scan is one row, so that it reads memory in order
    steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.intp) * 8
    flat = NEXT.ravel()
    whole = np.tile(np.arange(8, dtype=np.intp), (rows, 1))
    for step in steps:
        whole = flat.take(step[:, None] + whole).astype(np.intp)
    entry = np.empty(rows, np.intp)
    state = START
    for i, row in enumerate(whole.tolist()):
        entry[i] = state
        state = row[state]
    before = np.empty((BLOCK, rows), np.uint8)
    for i, step in enumerate(steps):
        before[i] = entry
        entry = flat.take(step + entry).astype(np.intp)
    return before.T.reshape(-1)[:n]


def token_starts(texts: list[str]) -> list[np.ndarray]:
    """Per text the code-point positions where the pattern's matches start. Matches cover a text without gaps."""
    joined = "\0".join(texts)
    if not joined:
        return [np.empty(0, np.int64) for _ in texts]
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    breaks = (begin + lengths)[:-1]
    kinds = symbols(codes, breaks)
    at = np.flatnonzero(STARTS.ravel()[kinds.astype(np.intp) * 8 + states_before(kinds)])
    edges = np.searchsorted(at, np.c_[begin, begin + lengths])
    return [at[a:b] - s for (a, b), s in zip(edges.tolist(), begin.tolist())]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, {i: token for token, i in ranks.items()}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= 32 else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < NEVER:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap: n log n however long the piece is."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(piece[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, end[right]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


_CACHES: dict[str, WordCache] = {}


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of every text; pieces are merged once and kept, up to a bounded number of short ones."""
    ranks, _ = load_ranks(path)
    cache = _CACHES.setdefault(path, WordCache())
    recent = cache.new.get
    out = []
    for text, starts in zip(texts, token_starts(texts)):
        edges = [*starts.tolist(), len(text)]
        pieces = list(map(text.__getitem__, map(slice, edges, edges[1:])))
        found = list(map(recent, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is not None:
                    continue
                piece = pieces[i]
                ids = recent(piece) or cache.older(piece)
                if ids is None:
                    ids = np.array(merge(piece.encode("utf-8"), ranks), "<i4").tobytes()
                if len(piece) <= CACHE_LENGTH:
                    cache.put(piece, ids)
                    recent = cache.new.get
                found[i] = ids
        out.append(np.frombuffer(b"".join(found), "<i4"))
    return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(rows) if rows else np.empty(0, np.int32))


@lru_cache(maxsize=4)
def widths(path: str) -> np.ndarray:
    """Bytes of every token by id, 0 for an unused id."""
    _, tokens = load_ranks(path)
    width = np.zeros(max(tokens) + 1, np.int32)
    width[list(tokens)] = [len(t) for t in tokens.values()]
    return width


def decoded_rows(flat: np.ndarray, lengths: np.ndarray, path: str) -> pa.BinaryArray:
    """Bytes of rows of ids that lie one after the other: tokens are joined once, and the places where the tokens of a
    row start and end cut the result. An unknown id raises KeyError."""
    _, tokens = load_ranks(path)
    data = b"".join(map(tokens.__getitem__, flat.tolist()))
    ends = np.r_[0, np.cumsum(widths(path)[flat], dtype=np.int64)][np.r_[0, np.cumsum(lengths)]]
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): token ids of the whole text, and the byte where each token starts in its UTF-8.

    Null and empty texts have no ids. No special tokens are recognised or added. One row per input row, ties and
    repeated ids included; other columns are ignored.
    """

    def run(batches):
        width = widths(path)
        for batch in slices(batches, "text", 2 << 20):
            ids = encode_texts([t or "" for t in batch.column("text").to_pylist()], path)
            starts = [np.cumsum(width[x], dtype=np.int32) - width[x] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), _lists(starts)], names=["doc_id", "ids", "offsets"])

    return _source(df, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): as ``encode`` and then ``decode``, in one pass over the texts."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            ids = encode_texts([t or "" for t in batch.column("text").to_pylist()], path)
            lists = _lists(ids)
            decoded = decoded_rows(lists.values.to_numpy(), np.diff(lists.offsets.to_numpy()), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], names=["doc_id", "ids", "decoded"])

    return _source(df, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes of an id array as binary column; null ids give empty bytes, an unknown id raises KeyError."""
    kept = [c for c in df.columns if c != into]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != into), f"`{into}` binary"])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = part.column(ids)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                decoded = decoded_rows(lists.flatten().to_numpy(zero_copy_only=False), lengths, path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), decoded], names=[*kept, into])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
