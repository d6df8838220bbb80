"""The fare panel that every registered query reads, derived by Spark from the ``orders`` table.

All values are integer arithmetic on the order and customer keys, so another engine reproduces them
exactly. One order group is one schedule slot; a slot is seen at up to 22 (horizon, half-day) points.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import history, market, pairs
from farepanel.session import materialise

EPOCH = "2026-05-01"
ERA_SWITCH = "2026-04-20"
CUTOFF = "2026-05-25"

# Validation folds of the derived panel, both ends included.
FOLDS = (
    ("F1", "SCREEN", "2026-04-20", "2026-04-26"),
    ("F2", "SCREEN", "2026-04-27", "2026-05-03"),
    ("F3", "SCREEN", "2026-05-04", "2026-05-10"),
    ("F4", "LATE", "2026-05-11", "2026-05-17"),
    ("F5", "LATE", "2026-05-18", "2026-05-24"),
)
# Two prospective blocks of the derived panel, both ends included.
BLOCKS = (("TEST_1", "2026-05-03", "2026-05-13"), ("TEST_2", "2026-05-14", "2026-05-24"))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


class Panel:
    """Tables of one data folder.

    Three stages are written to the shared folder once per application and read by everything after
    them: the standard offers, the batch calendar and the featured offers. All other tables are lazy
    plans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = materialise(build(), name)
        return _STORED[key]

    @cached_property
    def slots(self) -> DataFrame:
        order, customer = F.col("o_orderkey"), F.col("o_custkey")
        return (
            self.table("orders")
            .select(
                (customer % 20).alias("rid"),
                (F.expr("o_custkey + o_orderkey div 40") % 5).alias("aid"),
                (order % 40).alias("fd"),
                (F.expr("o_orderkey div 40") * 37 % 1440).alias("dmin"),
                order.alias("k"),
            )
            .groupBy("rid", "aid", "fd", "dmin")
            .agg(F.min("k").alias("k"))
        )

    @cached_property
    def observed(self) -> DataFrame:
        """Slot x horizon x half-day with its surrogate columns; the fan-out is the fixed 22-point grid."""
        k, dud, pm = F.col("k"), F.col("dud"), F.col("pm")
        duds = F.array(*[F.lit(d) for d in C.BOOKING_WINDOWS])
        return (
            self.slots.withColumn("dud", F.explode(duds))
            .withColumn("pm", F.explode(F.array(F.lit(0), F.lit(1))))
            .where((k * 13 + dud * 7 + pm * 3) % 10 < 7)
        )

    @cached_property
    def offers(self) -> DataFrame:
        """Standard offers table, clustered by session date so that date filters skip row groups."""
        return self.stored("offers", lambda: self.derived_offers.repartitionByRange("session_date"))

    @cached_property
    def feature_table(self) -> DataFrame:
        """Featured offers table for the consumers of the feature chain."""
        return self.stored("featured", lambda: self.featured)

    @property
    def featured_once(self) -> DataFrame:
        """Featured offers for a consumer that reads a few columns once: the written table if there is one already, else
        the plan, of which Spark then computes those columns only."""
        return _STORED.get((self.spark.sparkContext.applicationId, self.sf_dir, "featured"), self.featured)

    @cached_property
    def derived_offers(self) -> DataFrame:
        """Standard offers: one row per (batch, slot)."""
        k, dud, pm = F.col("k"), F.col("dud"), F.col("pm")
        epoch = F.lit(EPOCH).cast("date")
        route = F.element_at(F.array(*[F.lit(r) for r in C.ROUTE_CEILINGS]), (F.col("rid") + 1).cast("int"))
        airline = F.element_at(F.array(*[F.lit(a) for a in C.AIRLINES]), (F.col("aid") + 1).cast("int"))
        fd, dmin = F.col("fd").cast("int"), F.col("dmin").cast("int")
        start = F.when(pm == 0, 8).when(k % 4 == 0, 25).otherwise(19)
        session_date = F.date_add(epoch, fd - dud)
        session_id = session_date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), start)
        zero = F.lit(0)
        base = self.observed.select(
            (k * 1000 + dud * 10 + pm).alias("offer_id"),
            k.alias("schedule_slot_id"),
            session_id.alias("session_id"),
            (session_id + F.make_dt_interval(zero, zero, ((k * 7 + dud) % 90).cast("int"))).alias("scraped_at"),
            session_date.alias("session_date"),
            F.when(pm == 1, "PM").otherwise("AM").alias("session_label"),
            (F.unix_date(session_date) * 2 + pm).alias("session_key"),
            route.alias("route"),
            airline.alias("airline"),
            F.date_add(epoch, fd).alias("flight_date"),
            dud.alias("days_until_departure"),
            (F.date_add(epoch, fd).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, dmin)).alias(
                "departure_time"
            ),
            dmin.alias("departure_minute"),
            K.hhmm(dmin).alias("departure_hhmm"),
            F.expr(
                "((500000 + (k * 7919) % 2500000) * (80 + (k * 31 + dud * 17 + pm * 13) % 41)) div 100"
            ).alias("price_vnd"),
            F.when(session_date < F.lit(ERA_SWITCH).cast("date"), C.FLI_ERA).otherwise(C.TRIP_ERA).alias(
                "collection_era"
            ),
            F.when(k % 5 == 0, F.lit(None))
            .when(k % 5 == 1, F.concat(F.lit(" "), (100 + k % 900).cast("string"), F.lit(".0")))
            .when(k % 5 == 2, F.concat_ws("-", airline, F.lpad(K.hhmm(dmin).cast("string"), 4, "0")))
            .otherwise(F.concat(airline, (100 + k % 900).cast("string")))
            .alias("flight_no"),
            (((k * 37 + dud * 11 + pm * 5) % 97 + 1) / F.lit(100.0)).alias("p_drop"),
            ((k * 53 + dud * 29 + pm * 7) % 41 - 20).alias("noise"),
        )
        return base.withColumn(
            "pred_vnd", F.expr("price_vnd * (200 + noise) div 200")
        ).drop("noise")

    @cached_property
    def raw(self) -> DataFrame:
        """Offers plus resumed scrapes (later, dearer) and exact repeats, as a collector leaves them."""
        key = F.col("schedule_slot_id") + F.col("days_until_departure")
        again = self.offers.where(key % 23 == 0).select(
            *[
                {
                    "scraped_at": (F.col("scraped_at") + F.expr("INTERVAL '30' MINUTE")).alias("scraped_at"),
                    "price_vnd": (F.col("price_vnd") + 50_000).alias("price_vnd"),
                }.get(c, F.col(c))
                for c in self.offers.columns
            ]
        )
        return self.offers.unionByName(again).unionByName(self.offers.where(key % 29 == 0))

    @cached_property
    def raw_text(self) -> DataFrame:
        """Text form of the offers with unparsable and non-positive cells, as read from CSV."""
        k, dud = F.col("schedule_slot_id"), F.col("days_until_departure")
        price = (
            F.when((k + dud * 3) % 101 == 0, "n/a").when((k + dud * 3) % 103 == 0, "-5").otherwise(
                F.col("price_vnd").cast("string")
            )
        )
        stamp = F.when((k + dud * 5) % 107 == 0, "unknown").otherwise(F.col("scraped_at").cast("string"))
        return self.offers.select(
            "offer_id",
            stamp.alias("scraped_at"),
            F.col("session_id").cast("string").alias("session_id"),
            "route",
            "airline",
            F.col("flight_date").cast("string").alias("flight_date"),
            F.col("departure_time").cast("string").alias("departure_time"),
            F.when((k + dud) % 109 == 0, F.lit(None)).otherwise(dud.cast("string")).alias("days_until_departure"),
            price.alias("price_vnd"),
        )

    # --- derived stages -------------------------------------------------------------------

    @cached_property
    def timed(self) -> DataFrame:
        """Offers with their batch completion time; the batch calendar is a written table."""
        batches = self.stored("batches", lambda: market.batch_times(self.offers).coalesce(1))
        return market.batch_feature_time(self.offers, batches=batches)

    @cached_property
    def anchored(self) -> DataFrame:
        """Offers with batch time, cross-era market anchor and peer anchor."""
        return market.peer_anchor(market.market_anchor(self.timed, by_era=False))

    @cached_property
    def featured(self) -> DataFrame:
        """Anchored offers plus every strictly prior slot statistic."""
        return history.schedule_history(self.anchored, by_era=False)

    @cached_property
    def exact_pairs(self) -> DataFrame:
        return pairs.exact_next_pairs(self.timed)

    @cached_property
    def multi_pairs(self) -> DataFrame:
        return pairs.multi_horizon_pairs(self.timed)

    @cached_property
    def scored(self) -> DataFrame:
        """Exact pairs inside a validation fold, with a deterministic probability and quantiles."""
        return with_quantiles(with_folds(self.exact_pairs, FOLDS, "session_date")).where(F.col("fold").isNotNull())

    @cached_property
    def blocks(self) -> DataFrame:
        return with_quantiles(with_blocks(self.exact_pairs, "session_date")).where(F.col("block_id").isNotNull())


def between_dates(column: str, start: str, end: str):
    return F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def with_folds(df: DataFrame, folds, date: str) -> DataFrame:
    chain, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, kind, start, end in reversed(folds):
        hit = between_dates(date, start, end)
        chain, role = F.when(hit, name).otherwise(chain), F.when(hit, kind).otherwise(role)
    return df.withColumn("fold", chain).withColumn("fold_set", role)


def with_blocks(df: DataFrame, date: str) -> DataFrame:
    chain = F.lit(None).cast("string")
    for name, start, end in BLOCKS:
        chain = F.when(between_dates(date, start, end), name).otherwise(chain)
    return df.withColumn("block_id", chain)


def with_quantiles(df: DataFrame) -> DataFrame:
    """Log-relative target and seven deterministic quantiles; every tenth slot has crossed tails."""
    k, dud = F.col("schedule_slot_id"), F.col("days_until_departure")
    centre = ((k * 17 + dud) % 21 - 10) / F.lit(100.0)
    flip = F.when(k % 10 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    levels = [F.lit(-0.30) * flip, F.lit(-0.22), F.lit(-0.10), F.lit(0.0), F.lit(0.10), F.lit(0.22), F.lit(0.30) * flip]
    return df.withColumn("y_log", F.ln(F.col("target_price_vnd") / F.col("price_vnd"))).withColumn(
        "quantiles", F.array(*[centre + level for level in levels])
    )
