"""How far the sources of a language differ in their words: stripes folded in the mappers, merged by term.

A partition folds whole documents into one stripe per (language, term): the documents that hold the term, and its
occurrences by source. Stripes are handed on whenever the table is full, then merged by term. A merged stripe gives
all that its term adds to any divergence; what terms absent from a source add follows from counts alone, so nothing
is ever laid out as vocabulary x sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table, slices

TERM = re.compile(rb"[a-z\x80-\xff]+")  # over UTF-8 whose A-Z are lowered: letters and everything beyond ASCII
PIECE = 1 << 20
ROOM = 250_000  # (term, source) entries that a mapper holds before it hands its stripes on
LEAST_DOCUMENTS, TOP = 10, 10
UNIT = 1_000_000_000
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text, in pieces of about a megabyte that end between terms."""
    lowered, at = text.lower(), 0  # bytes.lower() touches A-Z only
    while at < len(lowered):
        end = min(at + PIECE, len(lowered))
        cut = TERM.match(lowered, end)
        end = cut.end() if cut else end
        yield TERM.findall(lowered, at, end)
        at = end


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array([x for r in rows for x in r], kind))


def _hand_on(stripes: dict[str, dict], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for lang, own in stripes.items():
        items = list(own.items())
        for i in range(0, len(items), rows):
            part = items[i : i + rows]
            columns = [
                pa.array([lang] * len(part), pa.string()),
                pa.array([term for term, _ in part], pa.binary()).cast(pa.string()),
                pa.array([stripe[0] for _, stripe in part], pa.int64()),
                _lists([list(stripe[1]) for _, stripe in part], pa.string()),
                _lists([list(stripe[1].values()) for _, stripe in part], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "sources", "counts"])


def fold(batches, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """Stripes of a partition. The empty term, which no text holds, counts the documents of every source."""
    stripes, entries = {}, 0
    for batch in slices(batches, "text"):
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            counts = Counter([b""])
            for piece in terms_of(text):
                counts.update(piece)
            own = stripes.setdefault(lang, {})
            for term, n in counts.items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = [1, {source: n}]
                    entries += 1
                    continue
                stripe[0] += 1
                by_source = stripe[1]
                if source in by_source:
                    by_source[source] += n
                else:
                    by_source[source] = n
                    entries += 1
            if entries > room:
                yield from _hand_on(stripes)
                stripes, entries = {}, 0
    yield from _hand_on(stripes)


def merged_stripes(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, docs, counts): every term in at least ``least`` documents of its language, with an array of
    (source, n), and per language the empty term with the documents of every source. Nulls read as ''.

    One exchange, of folded stripes: a term in every document costs one row per mapper and hand-over.
    """
    given = df.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))],
    )
    stripes = given.mapInArrow(fold, STRIPE).repartition("lang", "term")
    parts = stripes.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("pos", "x"))
    once = F.when(F.col("pos") == 0, F.col("docs")).otherwise(0)
    by_source = parts.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.sum(once).alias("docs"))
    merged = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return merged.where((F.col("docs") >= least) | (F.col("term") == ""))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) in whole numbers; null where the total is 0."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * n.cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(values, starts) if len(starts) else values


def fold_pairs(batches, room: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Sums over stripes, per pair of sources that share terms: what the pair adds beyond each source by itself.

    Stripes with equally many sources are laid side by side, and pairs are formed by their distance in the stripe, so
    that memory follows the stripes and the sums, not the pairs of one stripe.
    """
    index: dict[tuple[str, str], int] = {}
    names: list[tuple[str, str]] = []
    codes, values, waiting = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def settle() -> None:
        nonlocal codes, values, waiting
        c, v = _summed(np.concatenate(codes), np.concatenate(values))
        codes, values, waiting = [c], [v], 0

    def emit() -> pa.RecordBatch:
        a, b = codes[0] >> 32, codes[0] & 0xFFFFFFFF
        columns = [pa.array([names[i][0] for i in a.tolist()], pa.string()), *(pa.array([names[i][1] for i in x.tolist()], pa.string()) for x in (a, b)), pa.array(values[0], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        lists = batch.column("sources")
        offsets = lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        flat = pa.ListArray.from_arrays(lists.offsets, lists.values).flatten().to_pylist()
        first = int(offsets[0])
        ids = np.empty(len(flat), np.int64)
        for row, lang in enumerate(langs):
            for i in range(offsets[row] - first, offsets[row + 1] - first):
                key = (lang, flat[i])
                at = index.get(key)
                if at is None:
                    at = index[key] = len(names)
                    names.append(key)
                ids[i] = at
        p, zero = (batch.column(c).flatten().to_numpy() for c in ("p", "zero"))
        for k in np.unique(sizes).tolist():
            places = (offsets[:-1][sizes == k] - first)[:, None] + np.arange(k)
            for part in np.array_split(places, max(1, places.size // room + 1)):
                for d in range(1, k):
                    i, j = part[:, :-d].ravel(), part[:, d:].ravel()
                    codes.append(ids[i] << 32 | ids[j])
                    values.append(_gap(p[i], p[j]) - _gap(p[i], zero[j]) - _gap(zero[i], p[j]) + _gap(zero[i], zero[j]))
                    waiting += len(i)
                    if waiting > room:
                        settle()
                        if len(codes[0]) > room:
                            yield emit()
                            codes, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    settle()
    yield emit()


def divergences(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    ``pair``: every other source of the language and the sum of ``gap`` over all kept terms of the language, 0 if it
    keeps none. ``term``: of the terms that the source uses more than its language does, the ``top`` with the
    largest gap. Ties rank by item in byte order. Null text, language and source read as ''; a document without terms
    still counts its source. Repeated rows count each time, other columns are ignored, an empty table gives no rows.

    A pair of sources over all V terms is V gap(0a, 0b), where 0 stands for a term that the source lacks, plus what
    each source's own counts change against the other's 0, plus a correction for terms that both have. Only the last
    needs the terms, one stripe at a time; the middle part needs a source's distinct counts.
    """
    table = shared_table(merged_stripes(df, text, lang, source, least), "stripes")
    kept = table.where(F.col("term") != "")
    in_all = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    entries = kept.select("lang", "term", in_all.alias("in_all"), F.explode("counts").alias("x")).select("lang", "term", "in_all", "x.source", "x.n")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(in_all).alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seen = table.where(F.col("term") == "").select("lang", F.explode("counts").alias("x")).select("lang", "x.source")
    groups = seen.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    size = F.col("total") + 2 * F.col("v")
    groups = shared_table(
        groups.select("lang", "source", "v", size.alias("size"), (F.col("lang_total") + 2 * F.col("v")).alias("lang_size"), share(F.lit(2), size).alias("zero")),
        "stripe-groups",
    )
    entries = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n") + 2, F.col("size")))

    usual = share(F.col("in_all") + 2, F.col("lang_size"))
    above = entries.where(F.col("p") > usual).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), usual).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    shared = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("x")).where(F.size("x") > 1)
    both = shared.select("lang", F.col("x.source").alias("sources"), F.col("x.p").alias("p"), F.col("x.zero").alias("zero")).mapInArrow(
        fold_pairs, "lang string, a string, b string, value long"
    )
    others = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("q"))
    none = groups.select("lang", F.col("source").alias("a"), "v", "zero").join(others, "lang").where("a <> b")
    none = none.select("lang", "a", "b", F.coalesce(F.col("v") * gap(F.col("zero"), F.col("q")), F.lit(0)).alias("value"))
    counts = entries.groupBy("lang", F.col("source").alias("a"), "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    one = counts.join(others, "lang").where("a <> b")
    change = F.col("terms") * (gap(F.col("p"), F.col("q")) - gap(F.col("zero"), F.col("q")))
    one = one.groupBy("lang", "a", "b").agg(F.sum(change).alias("value"))
    mirrored = one.unionByName(both)
    parts = none.unionByName(mirrored).unionByName(mirrored.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(best, "term"))
