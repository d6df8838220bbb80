"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

Everything is built from Spark's own functions. A pattern's matches interleave with the pieces that ``split`` leaves
between them, so running lengths of both give the code-point offsets. The patterns are possessive and start only
where a match can start, which keeps them linear on long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base kinds: their order, digits of cards and phones.
BASE = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
CONTEXT_CHARS, THRESHOLD = 40, 0.6
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must hold to be searched at all, the score of a match, and words that raise it."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])", "", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, "ssn|social security|taxpayer"),
    Kind("local_phone", r"(?<![0-9+(])\(?+[0-9]{3}\)?+[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "", 0.4, "phone|tel|call|mobile|fax"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn checksum of the digits of a short string."""
    d = F.reverse(_digits(value))
    doubled = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    one = lambda i: F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 13616 checksum of an IBAN: the first four characters go last, letters count from 10."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    if kind == "card":
        return digits.between(*CARD_DIGITS) & luhn(value)
    if kind == "phone":
        return digits.between(*PHONE_DIGITS)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    if kind == "ssn":
        return ~F.rlike(value, F.lit("^(?:000|666|9..)-|-00-|-0000$"))
    return F.lit(True)


NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def spans_of_kind(text: Column, rank: int) -> Column:
    """Confirmed spans of one kind with their scores, in order; offsets are code points, the end is exclusive."""
    kind = KINDS[rank]
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("skip"), f.alias("value")))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["skip"]
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["list"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("list"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("list"))
    placed = F.filter(F.aggregate(pairs, empty, add, lambda acc: acc["list"]), lambda s: valid(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        before = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, before + 1, s["start"] - before))
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(rf"\b(?:{kind.context})")), 0.3).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(placed, scored)
    return F.when(F.contains(text, F.lit(kind.needs)), spans).otherwise(F.array().cast(NO_SPANS)) if kind.needs else spans


def with_spans(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Adds the spans of a whole text, ordered by start and kind: array of (start, rank, end, kind, score).

    Base kinds (email, ip, card, phone) stay whatever their score. The further kinds must pass their checksum or
    format, reach the threshold with their context words, and overlap no base span. Null and empty texts have no
    spans. Rows are independent of each other; every other column is kept, and one named like ``into`` is replaced.
    """
    names = [f"__{into}_{k.name}" for k in KINDS]
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = df.withColumns({n: spans_of_kind(source, i) for i, n in enumerate(names)})
    base = f"__{into}_base"
    found = found.withColumn(base, F.concat(*names[: len(BASE)]))

    def apart(name: str) -> Column:
        clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.filter(name, lambda s: (s["score"] >= THRESHOLD) & clear(s))

    ordered = F.array_sort(F.concat(base, *[apart(n) for n in names[len(BASE) :]]))
    return found.withColumn(into, ordered).drop(*names, base)


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Every span of the text is replaced by its kind in capitals and brackets, as ``[EMAIL]``. Overlapping spans
    become one, named by the first. A null text stays null; all other columns are unchanged."""
    spans, merged = "__pii_spans", "__pii_merged"

    def join(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(one)))

    column = F.col(f"`{text}`")
    found = with_spans(df, text, spans)
    found = found.withColumn(merged, F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), join))
    piece = lambda s, i: F.concat(
        F.substring(column, F.when(i > 0, F.get(F.col(merged), i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(F.col(merged), i - 1)["end"]).otherwise(0)),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    )
    last = F.try_element_at(F.col(merged), F.lit(-1))["end"]
    replaced = F.concat(F.array_join(F.transform(merged, piece), ""), F.substring(column, last + 1, F.length(column)))
    return found.withColumn(text, F.when(F.size(merged) > 0, replaced).otherwise(column)).drop(spans, merged)
