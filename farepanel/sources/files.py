"""Daily files, date spines, collection calendars and partitioned output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFER_FIELDS = (
    "scraped_at", "session_id", "origin", "dest", "route", "days_until_departure", "flight_date",
    "airline", "airline_name", "flight_no", "departure_time", "price_usd", "price_vnd",
)
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in OFFER_FIELDS])
DAILY_GLOB = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].csv"


def scan_daily(
    spark: SparkSession,
    path: str,
    cutoff: str,
    era: str,
    source: str,
    schema: T.StructType = RAW_SCHEMA,
    partitioned: bool = False,
) -> DataFrame:
    """Daily CSV files up to a cutoff, every cell as text, tagged with era, source, file and file date.

    The date is the file name, or with ``partitioned`` a ``file_date=`` folder, which prunes whole
    folders. A header that differs from the schema fails the scan.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).schema(schema)
    name = F.col("_metadata.file_name")
    if partitioned:
        full = T.StructType([*schema.fields, T.StructField("file_date", T.DateType())])
        df = reader.schema(full).csv(path)
    else:
        df = reader.option("pathGlobFilter", DAILY_GLOB).csv(path)
        df = df.withColumn("file_date", F.substring(name, 1, 10).try_cast("date"))
    return (
        df.withColumn("source_file", name)
        .where(F.col("file_date") <= F.lit(cutoff).cast("date"))
        .withColumn("collection_era", F.lit(era))
        .withColumn("data_source", F.lit(source))
    )


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the declared columns are read."""
    return spark.read.parquet(path).select(*columns)


def file_date_violations(df: DataFrame, scraped_at: str = "scraped_at", file_date: str = "file_date") -> DataFrame:
    """Rows scraped on another day than their file says."""
    return df.where(F.col(scraped_at).try_cast("timestamp_ntz").cast("date") != F.col(file_date))


def date_spine(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias(name))


def calendar_gaps(df: DataFrame, date_col: str, first: str, last: str) -> DataFrame:
    """Dates of a range without any row."""
    seen = df.select(F.col(date_col).alias("date")).distinct()
    return date_spine(df.sparkSession, first, last).join(seen, "date", "left_anti")


def collection_calendar(
    files: DataFrame, first: str, last: str, phases: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Every date of a range with its study phase, the sources present and whether a file exists."""
    present = files.groupBy("date").agg(
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("files"),
    )
    phase = F.lit("OUTSIDE_STUDY")
    for name, start, end in reversed(list(phases)):
        inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        phase = F.when(inside, name).otherwise(phase)
    return (
        date_spine(files.sparkSession, first, last)
        .join(present, "date", "left")
        .select(
            "date",
            phase.alias("phase"),
            F.coalesce("sources", F.lit("")).alias("sources"),
            F.coalesce("files", F.lit(0)).alias("files"),
            F.when(F.col("files") > 0, "OBSERVED").otherwise("NO_COLLECTION_FILE").alias("status"),
        )
    )


def missing_tasks(df: DataFrame, routes: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Expected (route, window) queries that the latest batch lacks; the grid is two fixed lists."""
    spark = df.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in routes])).alias("route"), F.lit(1).alias("one")
    ).select("route", F.explode(F.array(*[F.lit(w) for w in windows])).alias("days_until_departure"))
    keys = df.select("session_key", "route", "days_until_departure").distinct()
    latest = keys.agg(F.max("session_key").alias("session_key"))
    seen = keys.join(F.broadcast(latest), "session_key", "left_semi")  # one row
    return grid.join(seen, ["route", "days_until_departure"], "left_anti")


#: Evidence lines of a collector log and the queries of a complete run.
LOG_START, LOG_END, LOG_QUERIES = r"START\s+queries=(\d+)", r"END\s+rows=(\d+)\s+skipped=(\d+)/(\d+)", 220


def log_audit(lines: DataFrame, file: str = "file", text: str = "value", queries: int = LOG_QUERIES) -> DataFrame:
    """Start and end evidence of every collector log, and whether all queries ran and none was skipped.

    The first matching line of a log counts, by its place ``line``; a log without both lines is not complete.
    """
    found = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("bigint")
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("line")))
    numbers = lines.select(
        file, "line", found(LOG_START, 1).alias("s"), found(LOG_END, 1).alias("r"), found(LOG_END, 2).alias("k"), found(LOG_END, 3).alias("e")
    )
    out = numbers.groupBy(file).agg(
        F.count(F.lit(1)).alias("lines"),
        *[first(F.col(c)).alias(n) for c, n in (("s", "started"), ("r", "reported_rows"), ("k", "skipped"), ("e", "completed"))],
    )
    complete = (F.col("started") == queries) & (F.col("completed") == queries) & (F.col("skipped") == 0)
    return out.withColumn("complete", F.coalesce(complete, F.lit(False)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all logs under a folder with their file and their place in it; a log is one file of a few lines."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    cut = whole.select(F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "[/=]"), -1).alias("file"), F.split("value", "\n").alias("x"))
    return cut.select("file", F.posexplode("x").alias("line", "value")).where("value <> ''")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("session_date",)) -> None:
    """Replace exactly the partitions present in ``df``; rows are clustered by partition before the write."""
    (
        df.repartition(*by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


