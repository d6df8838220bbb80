"""Secrets in texts: fixed formats, and values beside credential words that would take many guesses.

A value's guess cost is the cheapest way to cut it into words, dates, repeats, keyboard walks and brute force, found by
dynamic programming over its characters; costs are bits, the logarithm of the guesses. Words and their ranks come from
counts over the whole corpus, so what is common there is a cheap guess.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import inf, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table, slices
from farepanel.llm.divergence import terms_of

#: Fixed values of the base kinds, in their order: patterns over UTF-8 and the least length of what they hold. The first
#: is sought in text whose A-Z are lowered, which changes no offset and no other class of it.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HEX = re.compile(rb"[0-9a-f]{%d,}" % LEAST_HEX)
HEX_DIGITS = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))

#: Where credentials stand: a word for one, a sign, a value; or the password of an address.
VALUE = "value"
CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|access|private|auth|client)[ _-]?(?:key|token|secret))s?["']?"""
    rb"""[\x20\t]{0,4}(?:[:=]=?>?|\x20is\x20)[\x20\t]{0,4}["']?([^\x00-\x20"'<>`,;]{6,})"""
)
ADDRESS = re.compile(rb"://[^\x00-\x20:/@]+:([^\x00-\x20/@]{6,})@")
HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key")
LEAST_BITS = 33.2  # about 10^10 guesses

#: Words that head every guesser's list, most common first (fixed values).
COMMON = (
    "password 123456 qwerty letmein welcome admin login master secret changeme default test guest root user dragon "
    "monkey football baseball superman batman iloveyou sunshine princess shadow trustno hello freedom whatever abc "
    "pass passw key token none null true false example sample secretkey apikey demo temp public private"
).split()
WORDS = 20_000  # words of the dictionary beyond the common ones
LONGEST_WORD = 24
LEET = str.maketrans("4301571@$!", "aeoistlasi")
#: Rows along which fingers or memory walk; the first four lie above each other.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
PERIODS = range(1, 9)
DATE = re.compile(r"(?:[0-9]{4}([-/._]?)[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/._]?)[0-9]{1,2}\2(?:[0-9]{4}|[0-9]{2})|(?:19|20)[0-9]{2})")
NOW, YEARS = 2025, 20


def _neighbours() -> dict[tuple[str, str], int]:
    """Direction of every step between adjacent keys, and between adjacent letters of the alphabet."""
    steps = {}
    for row, keys in enumerate(ROWS):
        for i, key in enumerate(keys):
            for other, d in ((i + 1, 1), (i - 1, 2)):
                if 0 <= other < len(keys):
                    steps.setdefault((key, keys[other]), d if row < 4 else d + 8)
            for shift, d in ((0, 3), (-1, 4)):  # the row below is set half a key to the right
                if row < 3 and 0 <= i + shift < len(ROWS[row + 1]):
                    below = ROWS[row + 1][i + shift]
                    steps.setdefault((key, below), d)
                    steps.setdefault((below, key), d + 2)
    return steps


STEPS = _neighbours()
SEGMENT = 1.0  # bits that every segment costs besides its content
WALK_START, WALK_ON, WALK_TURN = log2(sum(map(len, ROWS))), 0.5, log2(5)


def char_bits(char: str) -> float:
    """Bits to guess one character by brute force, given its class."""
    if char.isascii():
        return log2(10) if char.isdigit() else log2(26) if char.isalpha() else log2(33)
    return log2(100)


def word_bits(word: str, rank: Callable[[str], int | None]) -> float:
    """Cheapest reading of a whole word: as it is, with digits for letters, or backwards; capitals cost bits."""
    lowered = word.lower()
    plain = lowered.translate(LEET)
    swaps = sum(a != b for a, b in zip(lowered, plain))
    readings = [(lowered, 0.0), (lowered[::-1], 1.0)] + ([(plain, 1.0 + swaps)] if swaps else [])
    best = min((log2(r) + extra for text, extra in readings if (r := rank(text))), default=inf)
    upper = sum(c.isupper() for c in word)
    return best + (0.0 if not upper else 1.0 if word[0].isupper() and upper == 1 or upper == len(word) else 1.0 + upper)


def date_bits(text: str) -> float:
    """Bits of a date or year: days of a year times the distance from now, two more for separators; inf if it is none."""
    found = DATE.fullmatch(text)
    if not found:
        return inf
    parts = re.split("[-/._]", text)
    if len(text) == 4 and len(parts) == 1 and text[:2] in ("19", "20"):
        return log2(max(abs(int(text) - NOW), YEARS))
    digits = "".join(parts)
    readings = []
    if len(parts) == 3:
        a, b, c = map(int, parts)
        readings = [(a, b, c)] if len(parts[0]) == 4 else [(c, b, a), (c, a, b)]
    elif len(digits) == 8:
        readings = [(int(digits[:4]), int(digits[4:6]), int(digits[6:])), (int(digits[4:]), int(digits[2:4]), int(digits[:2])), (int(digits[4:]), int(digits[:2]), int(digits[2:4]))]
    elif len(digits) == 6:
        a, b, c = int(digits[:2]), int(digits[2:4]), int(digits[4:])
        readings = [(a, b, c), (c, b, a), (c, a, b)]
    whole = lambda year: year if year > 99 else year + (2000 if year <= NOW % 100 + YEARS else 1900)
    years = [whole(year) for year, month, day in readings if 1 <= month <= 12 and 1 <= day <= 31 and 1900 <= whole(year) <= 2099]
    return min((log2(365 * max(abs(year - NOW), YEARS)) for year in years), default=inf) + (2.0 if len(parts) == 3 else 0.0)


def guess_bits(value: str, rank: Callable[[str], int | None]) -> float:
    """Least bits over all segmentations of a value; linear in its length.

    Segments: dictionary words of 3 to ``LONGEST_WORD`` characters; dates; repeats, which take the longest run of whole
    units (up to eight characters, guessed by brute force) that ends at their last character; walks of three or more
    adjacent keys, where turns cost more than going on; and runs of brute force. Each segment costs ``SEGMENT`` more.
    """
    n, lowered = len(value), value.lower()
    cost = [char_bits(c) for c in value]
    total = [0.0]
    for c in cost:
        total.append(total[-1] + c)
    best, brute, pair, walk = [0.0] + [inf] * n, inf, [inf] * (n + 1), [inf] * (n + 1)
    same = {p: 0 for p in PERIODS}
    direction = [0, 0] + [STEPS.get((a, b), 0) for a, b in zip(lowered, lowered[1:])]
    for end in range(1, n + 1):
        brute = min(brute, best[end - 1] + SEGMENT) + cost[end - 1]
        least = brute
        step = direction[end]
        if step:
            pair[end] = best[end - 2] + SEGMENT + WALK_START + WALK_ON
            walk[end] = min(pair[end - 1], walk[end - 1]) + (WALK_ON if step == direction[end - 1] else WALK_TURN)
            least = min(least, walk[end])
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            bits = word_bits(value[start:end], rank)
            if bits < inf:
                least = min(least, best[start] + SEGMENT + bits)
        for length in (4, 6, 8, 9, 10):
            if end >= length and value[end - 1].isdigit():
                least = min(least, best[end - length] + SEGMENT + date_bits(value[end - length : end]))
        for period in PERIODS:
            run = same[period] = same[period] + 1 if end > period and value[end - 1] == value[end - 1 - period] else 0
            units = run // period + 1
            if units > 1 and units * period >= 3:
                start = end - units * period
                least = min(least, best[start] + SEGMENT + total[start + period] - total[start] + log2(units))
        best[end] = least
    return best[n]


def base_spans(text: bytes, lowered: bytes) -> list[tuple[int, int, int, bytes | None]]:
    """Base spans in bytes: start, rank of the kind, end, and the value of an assignment."""
    found = []
    if any(hint in lowered for hint in HINTS):
        found = [(m.start(), 0, m.end(), text[m.start(1) : m.end(1)]) for m in ASSIGN.finditer(lowered) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if text.translate(HEX_DIGITS).find(b"x" * LEAST_HEX) >= 0:
        found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: bytes, lowered: bytes) -> Iterator[tuple[int, int]]:
    """Values beside credential words and in addresses, without closing punctuation."""
    patterns = [CONTEXT] * any(hint in lowered for hint in HINTS) + [ADDRESS] * (b"://" in lowered)
    for pattern in patterns:
        for m in pattern.finditer(lowered):
            start, end = m.span(1)
            end = start + len(text[start:end].rstrip(b".)]}!?:"))
            if end - start >= 6:
                yield start, end


def spans_of(text: bytes, rank: Callable[[str], int | None], least_bits: float = LEAST_BITS) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, bits) of a text in UTF-8, by start and kind; offsets are code points, the end is exclusive.

    Base kinds stay whatever their bits, which are given for assigned values only. A further value must take
    ``least_bits`` and overlap no base span and no value before it.
    """
    lowered = text.lower()
    base = base_spans(text, lowered)
    found = [(start, kind, end, None if value is None else guess_bits(value.decode("utf-8", "replace"), rank)) for start, kind, end, value in base]
    last = 0
    for start, end in sorted(set(context_values(text, lowered))):
        if start >= last and not any(a < end and start < b for a, _, b, _ in base):
            bits = guess_bits(text[start:end].decode("utf-8", "replace"), rank)
            if bits >= least_bits:
                found.append((start, len(BASE), end, bits))
                last = end
    if not text.isascii():
        points, at, count = {}, 0, 0
        for place in sorted({p for start, _, end, _ in found for p in (start, end)}):
            count += len(text[at:place].decode("utf-8", "replace"))
            points[place], at = count, place
        found = [(points[start], kind, points[end], bits) for start, kind, end, bits in found]
    return [(start, end, (*BASE, VALUE)[kind], bits) for start, kind, end, bits in sorted(found, key=lambda x: x[:3])]


def count_words(batches, room: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts, handed on whenever ``room`` of them are held."""

    def hand_on(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) > 2 and len(w) <= 4 * LONGEST_WORD]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            for piece in terms_of(text):
                counts.update(piece)
                if len(counts) > room:
                    yield hand_on(counts)
                    counts = Counter()
    yield hand_on(counts)


def _bytes(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")


def dictionary(df: DataFrame, text: str = "text", words: int = WORDS) -> dict[str, int]:
    """Rank of every word that guesses try early: the common ones, then the ``words`` most frequent of the whole table
    (3 to ``LONGEST_WORD`` letters, A-Z lowered, ties by word). This bound is what reaches the driver and the tasks.

    Bands of counts, a sixteenth of an octave wide, tell from which count on there are enough words, so that only words
    at or above that band are ranked, however many partitions hold them.
    """
    counted = df.select(_bytes(df, text).alias("text")).mapInArrow(count_words, "word string, n long")
    usable = F.length("word").between(3, LONGEST_WORD) & ~F.col("word").isin(COMMON)
    counted = shared_table(counted.where(usable).groupBy("word").agg(F.sum("n").alias("n")), "words")
    band = F.floor(F.log2("n") * 16)
    sizes = {r.band: r.n for r in counted.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = max(sizes, default=0), 0
    for at in sorted(sizes, reverse=True):
        if held >= words:
            break
        least, held = at, held + sizes[at]
    top = counted.where(band >= least).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    return {word: i for i, word in enumerate([*COMMON, *(r.word for r in top)], 1)}


SPANS = "array<struct<start:bigint,end:bigint,kind:string,bits:double>>"


def with_spans(df: DataFrame, ranks: dict[str, int], text: str = "text", into: str = "spans", least_bits: float = LEAST_BITS) -> DataFrame:
    """Adds the spans of a whole text as an array of (start, end, kind, bits), ordered by start and kind.

    Null and empty texts have none. Rows are independent of each other; every other column is kept, and one named like
    ``into`` is replaced. ``ranks`` is a dictionary of bounded size, as ``dictionary`` gives it.
    """

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        rank = ranks.get
        rows = [[dict(zip(("start", "end", "kind", "bits"), s)) for s in spans_of(t.as_py(), rank, least_bits)] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("bits", pa.float64())])))

    return df.withColumn(into, scan(_bytes(df, text)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
