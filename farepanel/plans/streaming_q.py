"""Streaming queries: the panel is replayed through files in time order and compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import quality
from farepanel.plans.history_q import OFF_HALF, r
from farepanel.plans.registry import query, view
from farepanel.plans.sources_q import scratch
from farepanel.streaming import ingest, state, store

CUTS = ("2026-01-01", "2026-04-01", "2026-04-25", "2026-05-10", "2027-01-01")


def replay(p, df, name: str, consume, date: str = "session_date") -> str:
    """Write a table as four consecutive drops and consume each as it arrives, from one checkpoint."""
    path = scratch(p, name)
    for first, last in zip(CUTS[:-1], CUTS[1:]):
        df.where(f"{date} >= date '{first}' and {date} < date '{last}'").write.mode("append").parquet(path)
        consume(ingest.read_offers(p.spark, path, df.schema))
    return path


def into_changelog(p, df, name: str, transform, mode: str = "update") -> str:
    out, checkpoint = point(p), point(p)
    replay(p, df, name, lambda stream: ingest.run(transform(stream), checkpoint, ingest.changelog_writer(out), mode))
    return out


def point(p) -> str:
    return scratch(p, f"stream-{uuid.uuid4().hex[:6]}")


@query(
    "stream_prepare",
    """SELECT offer_id, session_label, CAST(session_key AS INTEGER) AS session_key FROM offers""",
)
def stream_prepare(p):
    text = p.offers.select(
        "offer_id", "route", "airline", "session_date",
        *[F.col(c).cast("string").alias(c) for c in ("scraped_at", "session_id", "flight_date", "departure_time", "price_vnd", "days_until_departure")],
    )
    prepared = lambda stream: ingest.prepare(stream).select("offer_id", "session_label", "session_key")
    out = into_changelog(p, text, "prepare", prepared, "append")
    return p.spark.read.parquet(out).drop("batch_id")


@query(
    "stream_session_window",
    """SELECT session_date, session_label, count(*) AS rows, max(scraped_at) AS last_scrape FROM raw_offers GROUP BY ALL""",
)
def stream_session_window(p):
    flat = lambda stream: ingest.session_counts(stream).select(F.col("w.start").alias("start"), "rows", "last_scrape")
    out = into_changelog(p, p.raw, "window", flat)
    latest = ingest.latest_version(p.spark, out, ["start"])
    start = F.col("start").cast("timestamp_ntz")
    return latest.select(
        start.cast("date").alias("session_date"), F.when(F.hour(start) == 6, "AM").otherwise("PM").alias("session_label"), "rows", "last_scrape"
    )


@query("stream_dedup", "SELECT session_key, schedule_slot_id, scraped_at, price_vnd FROM completed")
def stream_dedup(p):
    columns = ["session_key", "schedule_slot_id", "scraped_at", "price_vnd"]
    latest = lambda stream: ingest.latest_offers(stream, ["price_vnd", "session_key"]).select(*columns)
    out = into_changelog(p, p.raw, "dedup", latest)
    return ingest.latest_version(p.spark, out, ["session_key", "schedule_slot_id"])


STORE = ["schedule_slot_id", "session_key", "session_id", "scraped_at", "route", "airline", "days_until_departure", "price_vnd", "session_date", "session_label"]


def replayed(p, df, twice=True, **rules):
    """Replay offers into a store; the second run replays the same files from a new checkpoint and must change nothing."""
    kept, checkpoint = store.OfferStore(p.spark, point(p), **rules), point(p)
    path = replay(p, df, "store", lambda stream: ingest.run(stream, checkpoint, kept.write, "append"))
    if twice:
        ingest.run(ingest.read_offers(p.spark, path, df.schema), point(p), kept.write, "append")
    return kept


def per_batch(df):
    return df.groupBy("session_date", "session_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("price_vnd").alias("price_sum"), F.max("scraped_at").alias("last_scrape")
    )


@query(
    "stream_upsert",
    """SELECT session_date, session_label, count(*) AS rows, CAST(sum(price_vnd) AS BIGINT) AS price_sum, max(scraped_at) AS last_scrape FROM completed GROUP BY ALL""",
)
def stream_upsert(p):
    df = p.raw.select(*STORE)
    kept = replayed(p, df, clean=quality.completed_batch_offers)
    return per_batch(kept.offers(df.schema))


@query(
    "stream_completeness",
    f"""SELECT session_date, session_label, CASE WHEN routes = 20 AND (airlines = {len(C.AIRLINES)} OR (session_label = 'AM' AND airlines >= 4)) AND duds = {sorted(C.BOOKING_WINDOWS)} THEN 'READY' ELSE 'FAILED' END AS status, rows FROM (
SELECT session_date, session_label, count(*) AS rows, count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines, list_sort(list_distinct(list(days_until_departure))) AS duds FROM completed GROUP BY ALL)""",
)
def stream_completeness(p):
    check = lambda df: quality.validate_batches(df, subset=F.col("session_label") == "AM")
    kept = replayed(p, p.raw.select(*STORE), twice=False, check=check, clean=quality.completed_batch_offers)
    return kept.manifest().select("session_date", "session_label", "status", "rows")


WITHIN = tuple(w for w in C.BOOKING_WINDOWS if w <= 30)
KNOWN_UNTIL = "2026-04-22"
CEILINGS = ", ".join(f"('{route}', {fare})" for route, fare in C.ROUTE_CEILINGS.items())
view(
    "store_standard",
    f"""SELECT * EXCLUDE (rn, ceiling) FROM (SELECT o.*, ceiling, row_number() OVER (PARTITION BY session_key, schedule_slot_id ORDER BY scraped_at DESC, session_id DESC, price_vnd DESC) AS rn
FROM (SELECT * REPLACE (price_vnd * (CASE WHEN schedule_slot_id % 31 = 0 THEN 9 ELSE 1 END) AS price_vnd) FROM raw_offers) o JOIN (VALUES {CEILINGS}) t(route, ceiling) USING (route) WHERE price_vnd <= ceiling) WHERE rn = 1""",
)
view(
    "store_promoted",
    f"""SELECT session_date, session_label FROM store_standard o LEFT JOIN (SELECT DISTINCT route, airline, TRUE AS known FROM store_standard WHERE session_date < DATE '{KNOWN_UNTIL}') k USING (route, airline)
GROUP BY ALL HAVING count(DISTINCT route) = 20 AND (count(DISTINCT airline) = {len(C.AIRLINES)} OR (session_label = 'AM' AND count(DISTINCT airline) >= 4))
AND list_sort(list(DISTINCT days_until_departure)) = {sorted(WITHIN)} AND bool_and(coalesce(known, FALSE))""",
)


@query(
    "stream_promote",
    """SELECT session_date, session_label, count(*) AS rows, CAST(sum(price_vnd) AS BIGINT) AS price_sum, max(scraped_at) AS last_scrape
FROM store_standard JOIN store_promoted USING (session_date, session_label) GROUP BY ALL""",
)
def stream_promote(p):
    """Every batch arrives whole twice: first without some of its slots and with other fares, then as it is. Only the
    standard tier is kept, horizons up to 30 days make a batch complete, and the registry knows the pairs of the days
    before a date."""
    df = p.raw.select(*STORE)
    dearer = F.when(F.col("schedule_slot_id") % 31 == 0, 9).otherwise(1)
    final = df.withColumn("price_vnd", F.col("price_vnd") * dearer)
    early = df.where("schedule_slot_id % 3 <> 0").withColumn("price_vnd", F.col("price_vnd") + 1000)
    known = store.standard_offers(final).where(f"session_date < date '{KNOWN_UNTIL}'").select(*store.PAIR).distinct()
    check = lambda rows: quality.validate_batches(rows, windows=WITHIN, subset=F.col("session_label") == "AM")
    kept = store.OfferStore(p.spark, point(p), check, True, known)
    for i, drop in enumerate((early, final)):
        path = scratch(p, f"promote-{i}")
        drop.write.parquet(path)
        ingest.run(ingest.read_offers(p.spark, path, df.schema), point(p), kept.write, "append")
    kept.compact(df.schema)
    kept.vacuum(keep=1)
    return per_batch(kept.offers(df.schema))


@query(
    "stream_history",
    """SELECT offer_id, CAST(prior_observation_count AS BIGINT) AS prior_observation_count, CAST(previous_price_same_schedule AS DOUBLE) AS previous_price_same_schedule,
round(prior_price_volatility_vnd, 3) + 0e0 AS prior_price_volatility_vnd, round(prior_price_trend_vnd_per_dud_day + 1.7e-5, 3) + 0e0 AS prior_price_trend_vnd_per_dud_day FROM featured""",
)
def stream_history(p):
    """Batches arrive out of order: a third of them with every drop, from the whole calendar."""
    keep = ["schedule_slot_id", "offer_id", "feature_time", "session_key", "price_vnd", "days_until_departure", "departure_time"]
    df, out, checkpoint, path = p.timed.select(*keep), point(p), point(p), scratch(p, "history")
    for third in range(3):
        df.where(F.pmod(F.xxhash64("session_key"), F.lit(3)) == third).write.mode("append").parquet(path)
        stream = ingest.read_offers(p.spark, path, df.schema)
        with state.on_rocksdb(p.spark):
            ingest.run(state.stateful_history(stream, delay="400 days"), checkpoint, ingest.changelog_writer(out))
    return ingest.latest_version(p.spark, out, ["offer_id"]).select(
        "offer_id", "prior_observation_count", "previous_price_same_schedule", r("prior_price_volatility_vnd", 3), r("prior_price_trend_vnd_per_dud_day", 3, OFF_HALF)
    )
