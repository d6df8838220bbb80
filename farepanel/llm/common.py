"""Helpers shared by the text operators: bounded Arrow slices, word hashes, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farepanel.session import checkpoint_root, remove

#: Shuffles are freed early, and a batch for Python holds little in either process.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
NULL_ID = -(1 << 63)  # stands for a null id in keys: it sorts before every other id
SLICE_BYTES = 8 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(doc_id: str = "doc_id") -> Column:
    """Id as a never-null long, so that it can be joined and ordered; a null id comes first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


@contextmanager
def lean(spark: SparkSession):
    """Jobs started inside free their shuffles once they end and give Python batches of about 4 MB."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; the shuffles behind it are freed at once, and Python gets
    batches of about 4 MB.

    ``spent`` removes it again, once nothing that is still to be computed reads it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    with lean(spark):
        df.write.parquet(path)
    table = spark.read.parquet(path)
    table.table_path = path
    return table


def spent(*tables: DataFrame | None) -> None:
    """Remove tables that ``shared_table`` wrote."""
    for table in tables:
        if table is not None and "table_path" in vars(table):
            remove(table.sparkSession, table.table_path)


_REMEMBERED: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What this worker process keeps for one operator from task to task. Workers outlive a stage, so what another
    operator has left is dropped."""
    for name in [name for name in _REMEMBERED if name != owner]:
        del _REMEMBERED[name]
    pa.default_memory_pool().release_unused()
    return _REMEMBERED.setdefault(owner, {}) if owner else {}


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, so that Python holds little at a time; what workers
    remember for other operators than ``owner`` is dropped."""
    remembered(owner)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64) + 64) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def ids_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.fill_null(batch.column(column), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def sequence_hashes(hashes: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(int(PRIME) * (2 * seed - 1) % (1 << 64))
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * factor + hashes[k : k + n]
    return mix(total ^ np.uint64(seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class WordCache:
    """At most ``size`` remembered results; the older half is forgotten unless it is asked for again."""

    def __init__(self, size: int = 400_000) -> None:
        self.half, self.new, self.old = size // 2, {}, {}

    def older(self, key):
        return self.old.get(key)

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


# --- key filter -----------------------------------------------------------------------------

FILTER_BITS, FILTER_HASHES = 1 << 27, 4  # largest bitmap (16 MB) and bits set per key


def _bit_places(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of a key of two longs in a bitmap of a power of two."""
    a = mix(first.view(np.uint64) ^ mix(second.view(np.uint64) + PRIME))
    b = mix(a) | np.uint64(1)
    return [(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(FILTER_HASHES)]


def key_filter(keys: DataFrame, first: str, second: str) -> tuple[int, np.ndarray]:
    """Bloom bitmap of the keys: (bits, bytes), 16 bits a key and 16 MB at most, so that a task can hold it.

    A key of the table always hits. Others may, more of them once the keys outgrow the bitmap: that costs work only.
    """
    count = keys.count()
    bits = min(max(1 << 15, 1 << max(16 * count - 1, 1).bit_length()), FILTER_BITS)

    def places(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (first, second))
            for place in _bit_places(a, b, bits):
                yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64))], names=["place"])

    set_bits = keys.select(F.col(first).cast("long"), F.col(second).cast("long")).mapInArrow(places, "place long")
    parts = set_bits.groupBy((F.col("place") / (1 << 15)).cast("long").alias("part")).agg(
        F.bitmap_construct_agg((F.col("place") % (1 << 15)).cast("long")).alias("bitmap")
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # at most 4,096 pieces of 4 kB
        table[row.part << 12 : (row.part + 1) << 12] = np.frombuffer(row.bitmap, np.uint8)
    return bits, table


def may_hold(given: tuple[int, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which keys the bitmap may hold."""
    bits, table = given
    hit = np.ones(len(first), bool)
    for place in _bit_places(first, second, bits):
        hit &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit
