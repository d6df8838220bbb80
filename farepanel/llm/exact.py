"""Exact duplicates through an extendible-hash index, with Spark's own functions only.

Copies are folded before anything else: rows are grouped by the hash of their normalised text and by the text
itself, so bytes are compared and a group of copies leaves every task as one row. The distinct keys form the index.
Its directory starts with one bucket per leading hash bits and doubles where a bucket is overfull: only the entries
of such buckets look at one more bit. Owner tasks hold ranges of directory prefixes and write them in order to the
shared folder. Entries of one bucket with equal hashes are chained in the order of their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm.common import shared_table

CAPACITY, MAX_DEPTH, START_DEPTH = 4096, 24, 4
BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), BLANK, "")


def prefix(key: str, depth: int) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, start: int = START_DEPTH, most: int = MAX_DEPTH) -> DataFrame:
    """(prefix, depth): the buckets of an extendible-hash directory over ``keys.h``.

    Keys are counted once per prefix of ``most`` bits; each doubling regroups the cells of the overfull buckets only.
    A bucket that is overfull at the last depth stays, and its entries are chained.
    """
    cells = keys.groupBy(prefix("h", most).alias("cell")).agg(F.count("*").alias("n"))
    buckets = None
    for depth in range(start, most + 1):
        cells = cells.withColumn("bucket", F.shiftright("cell", most - depth))
        full = cells.groupBy("bucket").agg(F.sum("n").alias("total"))
        fits = full.where((F.col("total") <= capacity) | F.lit(depth == most)).select(F.col("bucket").alias("prefix"), F.lit(depth).alias("depth"))
        buckets = fits if buckets is None else buckets.unionByName(fits)
        if depth == most:
            break
        over = shared_table(full.where(F.col("total") > capacity).select("bucket"), "directory")
        if over.isEmpty():
            break
        cells = cells.join(over, "bucket").select("cell", "n")
    return buckets


def entries(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, h, sha, norm) per row: the keys of the index, without other columns."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n_chars"), normalised(text).alias("norm"))
    return docs.withColumn("h", F.xxhash64("norm")).withColumn("sha", F.sha2("norm", 256))


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(prefix, depth, h, chain, sha, group_size, n_chars, keep_id): one entry per distinct normalised text.

    keep_id is the row with the most code points in its original text, then the smallest doc_id; null ids come last.
    """
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low")))
    folded = entries(df, doc_id, text).groupBy("h", "norm").agg(F.first("sha").alias("sha"), F.count("*").alias("group_size"), best.alias("best"))
    keys = shared_table(
        folded.select("h", "sha", "group_size", F.col("best.n_chars").alias("n_chars"), F.bitwise_not("best.low").alias("keep_id")),
        "exact-keys",
    )
    buckets = shared_table(directory(keys, capacity), "exact-directory")
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most one per level of the directory
    owned = None
    for depth in sorted(depths):
        level = buckets.where(F.col("depth") == depth)
        part = keys.withColumn("prefix", prefix("h", depth)).join(level, "prefix")
        owned = part if owned is None else owned.unionByName(part)
    if owned is None:
        owned = keys.select(F.lit(0).cast("long").alias("prefix"), "*", F.lit(0).alias("depth"))
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("h").orderBy("sha")))
    ordered = chained.withColumn("first_bits", F.call_function("shiftleft", F.col("prefix"), 62 - F.col("depth")))
    return shared_table(ordered.repartitionByRange("first_bits", "h").sortWithinPartitions("first_bits", "h", "chain").drop("first_bits"), "exact-index")


def lookup(df: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its index entry; ``keep`` names further columns to carry along as they are."""
    own = entries(df, doc_id, text).drop("norm")
    if keep:
        both = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
        own = both.select("row", F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n_chars"), normalised(text).alias("norm"))
        own = own.withColumn("h", F.xxhash64("norm")).withColumn("sha", F.sha2("norm", 256)).drop("norm")
    found = index.select("h", "sha", "group_size", F.col("n_chars").alias("keep_chars"), "keep_id", "prefix", "chain")
    return own.join(found, ["h", "sha"])


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket): one row per input row.

    Texts are equal if they are so after deleting every ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts
    the row with the most code points stays, then the smallest doc_id. Rows that repeat a doc_id with the same length
    are one document: all of them are kept or none. Null ids lose against any id of equal length and keep_id is null
    only if all are. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = lookup(df, build_index(df, doc_id, text, capacity), doc_id, text)
    kept = (F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), F.col("prefix").alias("bucket"))


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: exactly one per distinct normalised text, ties and repeated rows
    included (of rows equal in length and id any one, as they differ at most in white space or other columns)."""
    rows = lookup(df, build_index(df, doc_id, text), doc_id, text, keep=tuple(df.columns))
    stay = rows.where((F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return stay.groupBy("h", "sha").agg(F.first("row").alias("row")).select("row.*")
