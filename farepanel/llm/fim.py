"""Fill-in-middle: a text is cut at two token boundaries and its pieces change places, so that a model learns to fill gaps.

The boundaries of a text are kept as a learned rank index: straight segments from rank to code-point offset, each off
by at most ``ERROR``, and a residual byte per boundary that makes the prediction exact. A cut is one lookup in it.
Python fits the index, from an Arrow column that only Spark's side keeps; hashing, cutting and joining are columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, S, M = "<P>", "<S>", "<M>"  # fixed values of the contract: marks of prefix, suffix and middle
ERROR = 96  # code points that a segment may be off by; with rounding the residuals fit a signed byte
LONGEST = 1 << 20  # ranks of a segment, so that the slope's rounding stays below one code point
FRACTION = 20  # bits of the slope behind the point
BLOCK = 4 << 20
INDEX = "struct<n:bigint,starts:array<bigint>,offsets:array<bigint>,slopes:array<bigint>,residuals:binary>"


def boundaries(text: np.ndarray) -> np.ndarray:
    """Code-point offsets of the token boundaries of UTF-8 bytes, 0 first and the end last.

    A token is white space (any of six ASCII characters) and the run after it; white space at the end is one too.
    """
    found, points = [np.zeros(1, np.int64)], 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK + 1]
        space = (block == 32) | ((block >= 9) & (block <= 13))
        if at + BLOCK >= len(text):
            space = np.append(space, True)
        ends = np.flatnonzero(~space[:-1] & space[1:])
        count = np.cumsum((block[: len(space) - 1] & 0xC0) != 0x80, dtype=np.int64)
        found.append(count[ends] + points)
        points += int(count[-1])
    offsets = np.concatenate(found)
    return offsets if points == offsets[-1] else np.append(offsets, points)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """Segments (first rank, its offset, slope in 2^-20) and the residuals of all ranks.

    A segment grows while the cone of slopes through its first point stays open; blocks of ranks are tested at once
    and double in length, so the work stays linear in the ranks.
    """
    starts, slopes, parts, at, end = [], [], [], 0, len(offsets)
    while at < end:
        origin, low, high, stop, step, last = offsets[at], -np.inf, np.inf, at + 1, 256, min(end, at + LONGEST)
        while stop < last:
            rise = offsets[stop : min(stop + step, last)] - origin
            run = np.arange(stop - at, stop - at + len(rise))
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(rise)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            stop += fits
            if fits < len(rise):
                break
            step *= 2
        slope = round((low + high) / 2 * (1 << FRACTION)) if stop > at + 1 else 0
        parts.append(offsets[at:stop] - origin - (np.arange(stop - at) * slope >> FRACTION))
        starts.append(at)
        slopes.append(slope)
        at = stop
    return starts, offsets[starts].tolist(), slopes, np.concatenate(parts)


def rank_index(text: Column) -> Column:
    """Learned rank index of a text's token boundaries, as a struct: n tokens, segments, residuals + 128 as bytes."""

    @F.arrow_udf(INDEX)
    def index(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            data = text.as_buffer()
            offsets = boundaries(np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))
            starts, firsts, slopes, residuals = fit(offsets)
            rows.append((len(offsets) - 1, starts, firsts, slopes, (residuals + 128).astype(np.uint8).tobytes()))
        kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())
        names = ("n", "starts", "offsets", "slopes", "residuals")
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return index(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def offset_at(index: Column, rank: Column) -> Column:
    """Exact offset of a boundary: its segment's prediction, corrected by the stored residual."""
    segment = F.size(F.filter(index["starts"], lambda s: s <= rank)) - 1
    run = rank - F.get(index["starts"], segment)
    predicted = F.get(index["offsets"], segment) + F.shiftright(F.get(index["slopes"], segment) * run, FRACTION)
    residual = F.conv(F.hex(F.substring(index["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128
    return predicted + residual


def hash_of(doc_id: Column, place: int, seed: int) -> Column:
    """The place-th group of 8 hex digits of sha256('seed:doc_id') as a whole number; a null id reads as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "fim", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Adds a struct (n, form, prefix_chars, middle_chars, output, index) to every document.

    Cuts, form and order depend on the document's id alone, so a rerun gives the same rows. Texts that are empty or hold
    one of the marks stay plain, as do 100 - ``rate`` in 100 of the others; ``spm`` in 100 of the rest put the suffix
    first. Null counts as empty; a null id hashes as ''; equal ids are cut at ranks from the same hashes. Every row and
    every other column is kept, one named like ``into`` is replaced. Nothing is shuffled.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    indexed = df.select(F.struct(*kept).alias("row"), body.alias("body"), rank_index(F.col(f"`{text}`")).alias("index"))
    h = [hash_of(F.col("row")[doc_id], place, seed) for place in range(1, 5)]
    ranks = [h[i] % (F.col("index.n") + 1) for i in range(2)]
    marked = F.col("body").contains(P) | F.col("body").contains(S) | F.col("body").contains(M)
    form = F.when((F.col("body") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = indexed.select("*", form.alias("form"), F.least(*ranks).alias("first"), F.greatest(*ranks).alias("second"))
    cut = cut.select("row", "body", "index", "form", *[F.when(F.col("form") != "plain", offset_at(F.col("index"), F.col(c))).cast("int").alias(c) for c in ("first", "second")])
    piece = lambda a, b: F.substring(F.col("body"), a + 1, b - a)
    prefix, middle = piece(F.lit(0), F.col("first")), piece(F.col("first"), F.col("second"))
    suffix = piece(F.col("second"), F.length("body"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle))
        .otherwise(F.col("body"))
    )
    result = F.struct(
        F.col("index.n").alias("n"), "form", F.col("first").cast("long").alias("prefix_chars"),
        (F.col("second") - F.col("first")).cast("long").alias("middle_chars"), output.alias("output"), "index",
    )
    return cut.select("row", result.alias("result")).select("row.*", F.col("result").alias(into))


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation. Pieces hold no mark, and none can arise where one meets a piece."""
    first = F.when(form == "psm", F.instr(output, S)).otherwise(F.instr(output, P))
    last = F.instr(output, M)
    piece = lambda a, b: F.substring(output, a, b - a)
    one, two, middle = piece(F.lit(4), first), piece(first + 3, last), piece(last + 3, F.length(output) + 1)
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
