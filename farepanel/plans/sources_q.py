"""Queries over scans, sinks, calendars and collection logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from farepanel import config as C
from farepanel.operators import quality
from farepanel.plans.panel_views import DUDS, ROUTES
from farepanel.plans.registry import query, view
from farepanel.session import checkpoint_root
from farepanel.sources import files
from farepanel.sources.panel import CUTOFF

FIRST, LAST = "2026-02-25", "2026-06-15"
PHASES = (("DEVELOPMENT", "2026-03-01", "2026-05-02"), ("TEST_1", "2026-05-03", "2026-05-13"),
          ("TEST_2", "2026-05-14", "2026-05-24"))


def scratch(panel, name: str) -> str:
    """Fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(panel.spark)}/{name}-{uuid.uuid4().hex}"


DAILY = T.StructType([T.StructField(n, T.StringType()) for n in (
    "scraped_at", "session_id", "route", "days_until_departure", "flight_date", "airline", "departure_time", "price_vnd")])


@query(
    "scan_daily_offers",
    f"""SELECT CAST(scraped_at AS DATE) AS file_date, '{C.TRIP_ERA}' AS collection_era, count(*) AS rows,
       CAST(sum(price_vnd) AS BIGINT) AS price_sum
FROM raw_offers WHERE CAST(scraped_at AS DATE) <= DATE '{CUTOFF}' GROUP BY 1""",
)
def scan_daily_offers(p):
    path = scratch(p, "daily")
    date = F.col("scraped_at").cast("date").alias("file_date")
    daily = p.raw.select(*[F.col(c).cast("string") for c in DAILY.names], date)
    daily.repartition("file_date").write.partitionBy("file_date").option("header", True).csv(path)
    df = files.scan_daily(p.spark, path, CUTOFF, C.TRIP_ERA, "trip_com", DAILY, partitioned=True)
    return df.groupBy("file_date", "collection_era").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("price_vnd").cast("bigint")).alias("price_sum")
    )


@query(
    "calendar_gaps",
    f"""SELECT CAST(d AS DATE) AS date FROM range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 1 DAY) t(d)
WHERE CAST(d AS DATE) NOT IN (SELECT session_date FROM offers)""",
)
def calendar_gaps(p):
    return files.calendar_gaps(p.offers, "session_date", FIRST, LAST)


@query(
    "file_date_check",
    """SELECT session_date AS file_date, count(*) AS rows, min(scraped_at) AS first_scrape FROM raw_offers
WHERE CAST(scraped_at AS DATE) <> session_date GROUP BY 1""",
)
def file_date_check(p):
    bad = files.file_date_violations(p.raw.withColumn("file_date", F.col("session_date")))
    return bad.groupBy("file_date").agg(F.count(F.lit(1)).alias("rows"), F.min("scraped_at").alias("first_scrape"))


@query(
    "scan_standard_eras",
    f"""SELECT offer_id, collection_era, session_date FROM offers
WHERE session_date <= DATE '{CUTOFF}' AND ((collection_era = '{C.FLI_ERA}' AND session_date <= DATE '2026-04-17')
   OR (collection_era = '{C.TRIP_ERA}' AND session_date >= DATE '2026-04-22')) AND price_vnd > 0""",
)
def scan_standard_eras(p):
    ranges = {C.FLI_ERA: (None, "2026-04-17"), C.TRIP_ERA: ("2026-04-22", None)}
    return quality.select_eras(p.offers, ranges, CUTOFF).select("offer_id", "collection_era", "session_date")


@query("scan_projected", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_projected(p):
    return files.scan_parquet(p.spark, f"{p.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query(
    "write_partitioned",
    """SELECT session_date, count(*) AS rows, CAST(sum(price_vnd) AS BIGINT) AS price_sum FROM offers GROUP BY 1""",
)
def write_partitioned(p):
    path = scratch(p, "standard")
    files.write_partitioned(p.offers, path)
    back = p.spark.read.parquet(path)
    return back.groupBy("session_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("price_vnd").alias("price_sum"))


@query(
    "collection_calendar",
    f"""WITH files AS (SELECT DISTINCT session_date AS date, collection_era AS source FROM offers),
present AS (SELECT date, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS files FROM files GROUP BY 1),
spine AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 1 DAY) t(d))
SELECT date, CASE """
    + " ".join(f"WHEN date BETWEEN DATE '{s}' AND DATE '{e}' THEN '{n}'" for n, s, e in PHASES)
    + """ ELSE 'OUTSIDE_STUDY' END AS phase, coalesce(sources, '') AS sources, coalesce(files, 0) AS files,
CASE WHEN files > 0 THEN 'OBSERVED' ELSE 'NO_COLLECTION_FILE' END AS status FROM spine LEFT JOIN present USING (date)""",
)
def collection_calendar(p):
    seen = p.offers.select(F.col("session_date").alias("date"), F.col("collection_era").alias("source")).distinct()
    return files.collection_calendar(seen, FIRST, LAST, PHASES)


@query(
    "missing_tasks",
    f"""WITH grid AS (SELECT r.route, CAST(d.dud AS INTEGER) AS days_until_departure
FROM (SELECT unnest([{ROUTES}]) AS route) r, (VALUES {DUDS}) d(dud))
SELECT * FROM grid WHERE (route, days_until_departure) NOT IN (SELECT route, days_until_departure FROM offers
WHERE session_key = (SELECT max(session_key) FROM offers))""",
)
def missing_tasks(p):
    return files.missing_tasks(p.offers, list(C.ROUTE_CEILINGS), C.BOOKING_WINDOWS)


@query(
    "collector_log_audit",
    """SELECT file, 4 AS lines, started, rows AS reported_rows, skipped, started AS completed, started = 220 AND skipped = 0 AS complete
FROM (SELECT strftime(session_date, '%Y-%m-%d') || '_' || session_label AS file, count(DISTINCT (route, days_until_departure)) AS started,
count(*) AS rows, count(DISTINCT CASE WHEN session_key % 5 = 0 AND days_until_departure = 60 THEN route END) AS skipped FROM offers GROUP BY ALL)""",
)
def collector_log_audit(p):
    """Logs are written per batch as text files, one folder each, and read back from there."""
    run = p.offers.groupBy("session_date", "session_label").agg(
        F.countDistinct("route", "days_until_departure").alias("q"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.when((F.col("session_key") % 5 == 0) & (F.col("days_until_departure") == 60), F.col("route"))).alias("k"),
    )
    day = F.date_format("session_date", "yyyy-MM-dd")
    text = F.format_string("%s 08:00:00 START queries=%d\nheartbeat\nEND rows=%d skipped=%d/%d\nEND rows=0 skipped=0/0", day, "q", "n", "k", "q")
    path = scratch(p, "logs")
    run.select(F.concat_ws("_", day, "session_label").alias("file"), text.alias("value")).write.partitionBy("file").text(path)
    return files.log_audit(files.read_log(p.spark, path))
