"""Structured Streaming forms of ingest: same results as the batch operators.

Windows carry a watermark, so the state of an old session is dropped; resumed scrapes that arrive
within the delay still count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farepanel.operators import quality

SESSION = ("12 hours", "12 hours", "6 hours")
DELAY = "2 days"


def read_offers(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def prepare(stream: DataFrame) -> DataFrame:
    """Stateless normalisation and batch columns of arriving rows."""
    return quality.normalise(stream)



def session_counts(stream: DataFrame) -> DataFrame:
    """Rows and latest scrape per half-day session window."""
    timed = stream.withColumn("session_id", F.col("session_id").cast("timestamp")).withWatermark("session_id", DELAY)
    return timed.groupBy(F.window("session_id", *SESSION).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("scraped_at").alias("last_scrape")
    )


def latest_offers(stream: DataFrame, value: Sequence[str] = ("price_vnd",)) -> DataFrame:
    """Latest scrape per (session window, slot); a keep-first deduplication would be wrong here."""
    timed = stream.withColumn("session_id", F.col("session_id").cast("timestamp")).withWatermark("session_id", DELAY)
    newest = F.max(F.struct("scraped_at", *value)).alias("x")
    return timed.groupBy(F.window("session_id", *SESSION).alias("w"), "schedule_slot_id").agg(newest).select(
        F.col("w"), "schedule_slot_id", "x.*"
    )


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process everything available, one micro-batch after the other, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def changelog_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write updates under their batch id; a replayed batch replaces its own folder only."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_version(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current value of every key in a changelog."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])
