"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a vector of r + 1 bits. Each non-zero vector v makes a mask of the positions
whose vector has an odd product with v. Any r positions span at most r dimensions, so some v is orthogonal to all of
them: its mask leaves them out, and two fingerprints that differ only there agree under it. Every pair within the
radius therefore meets in one of the 2^(r+1) - 1 tables; no link is left to chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table, slices, words_of
from farepanel.llm.graph import components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
GROUP = 1024  # fingerprints that are compared with each other in one array; larger groups are covered once more
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; 0 for a text without words."""
    words = [w.translate(LOWER) for w in words_of(text)]
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hash_of = xxhash.xxh64_intdigest
    values = np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 1 << 16):
        part = values[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS, within: int = (1 << BITS) - 1) -> list[int]:
    """The covering masks over the set bits of ``within``. Vectors are dealt to positions in turn: all non-zero ones,
    or, for few positions, those with the highest bit set, which keeps every mask near half of the positions."""
    vectors, half = (1 << (radius + 1)) - 1, 1 << radius
    positions = [i for i in range(BITS) if within >> i & 1]
    label = {p: 1 + i % vectors if len(positions) >= vectors else half + i % half for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (label[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) per row, with ``keep`` as a struct column ``row``; fp is the fingerprint as a signed long."""
    own = [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    source = df.select(*own, *rest)

    def run(batches):
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(fps)] + [batch.column(c) for c in ("row",) if keep]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *(["row"] if keep else [])])

    row = f", row {source.schema['row'].dataType.simpleString()}" if keep else ""
    return source.mapInArrow(run, f"doc_id long, fp long{row}")


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs within the radius, at most one less than there are fingerprints."""
    seen = np.zeros(len(fps), bool)
    u, v = [], []
    for i in range(len(fps)):
        if seen[i]:
            continue
        front, seen[i] = [i], True
        while front:
            j = front.pop()
            near = np.flatnonzero(~seen & (np.bitwise_count(fps ^ fps[j]) <= radius))
            seen[near] = True
            front += near.tolist()
            u += [j] * len(near)
            v += near.tolist()
    return fps[u], fps[v]


def _links(grouped: DataFrame, radius: int) -> DataFrame:
    """(u, v): links inside the groups of (fps array) rows, none longer than GROUP."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for row in batch.column("fps"):
                u, v = _forest(np.array(row.as_py(), np.int64).view(np.uint64), radius)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return grouped.select("fps").mapInArrow(run, "u long, v long")


def _long(x: int):
    return F.lit(x - (1 << 64) if x >> 63 else x)


def links(points: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(u, v): enough pairs of distinct fingerprints within the radius to connect all that any such pairs connect.

    ``points`` has one row per distinct fingerprint ``fp``. Groups of a table that hold more than ``group`` of them
    are covered once more over the bits that their mask left out: members agree on all others, so any pair within
    the radius still meets. Each level halves the free bits; at 8 or fewer a group has at most 256 members.
    """
    masks_1 = masks(radius)
    columns = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(masks_1)]
    dealt = points.select("fp", F.explode(F.array(*columns)).alias("at")).select("fp", F.xxhash64("at.table", "at.bits").alias("key"), F.col("at.table").alias("table"))
    found, frees = None, {i: ((1 << BITS) - 1) & ~m for i, m in enumerate(masks_1)}
    while True:
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = shared_table(sizes, "simhash-groups")
        full = sizes.where(F.col("n") > group).select("key")
        small = dealt.join(sizes.where(F.col("n") <= group).select("key"), "key").select("key", "fp")
        fits = small.repartition("key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
        part = shared_table(_links(fits, radius).distinct(), "simhash-links")
        found = part if found is None else found.unionByName(part)
        if full.isEmpty():
            return found.distinct()
        hot = shared_table(dealt.join(full, "key").select("fp", "key", "table"), "simhash-hot")
        deeper, number = {}, 0
        choices = []
        for table, free in frees.items():
            for mask in masks(radius, free):
                deeper[number] = free & ~mask
                choices.append((table, number, mask - (1 << 64) if mask >> 63 else mask))
                number += 1
        cover = points.sparkSession.createDataFrame(choices, "table int, next int, mask long")
        dealt = hot.join(F.broadcast(cover), "table").select("fp", F.xxhash64("key", "next", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), F.col("next").alias("table"))
        frees = deeper


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, label, component_id): one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, shingles four of them; a shorter text is one
    shingle, and a text without words (null or empty) has fingerprint 0, linked like any other. component_id is the
    smallest doc_id that links of at most ``radius`` differing bits reach; rows with a null id count in a component
    but name it only if all ids are null. ``label`` identifies a component in any case. Repeated rows and ids are
    rows like others. Other columns are ignored, except those in ``keep``. An empty table gives no rows.
    """
    if radius != RADIUS and not 0 < radius <= 6:
        raise ValueError("radius must be from 1 to 6")
    rows = shared_table(fingerprints(df, doc_id, text, keep), "simhash-rows")
    points = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    labels = components(links(points.select("fp"), radius))
    named = points.join(labels.withColumnRenamed("u", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "label").join(least, "label")
    return rows.join(ids, "fp")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows with all their columns, one per component: the smallest doc_id, any one of rows that share it."""
    rows = near_groups(df, doc_id, text, radius, keep=tuple(df.columns))
    stay = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return stay.groupBy("label").agg(F.first("row").alias("row")).select("row.*")
