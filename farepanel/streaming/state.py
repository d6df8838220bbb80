"""Statistics of a slot's earlier offers while batches arrive in any order.

A slot's offers are kept as one value on RocksDB, packed in time order: one entry per batch that saw it, at most the
booking horizons times the half-days. An offer that arrives after later ones takes its place by time, and all offers
behind it are sent again with corrected values, so the newest version of every row equals the batch result. An event-time
timer drops the state of a slot once its departure and the allowed delay are past.

Every call on state is a round trip between Python and the JVM, and every row, state value and output of a slot is
converted by itself. So a slot costs one read and one write per micro-batch, and its offers go in as one column and out
as one row of arrays, which Spark lays out again.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

DELAY = "14 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_BATCH = -(2**63)

#: One kept offer: time in microseconds, batch, id, value, and what the trend is taken over. Its place is its first two.
EVENT, PLACE = struct.Struct("<qqqdd"), struct.Struct("<qq")
EVENTS = T.StructType([T.StructField("packed", T.BinaryType())])
OUTPUT = T.StructType(
    [
        T.StructField("offer_id", T.LongType()),
        T.StructField("prior_observation_count", T.LongType()),
        T.StructField("previous_price_same_schedule", T.DoubleType()),
        T.StructField("prior_price_volatility_vnd", T.DoubleType()),
        T.StructField("prior_price_trend_vnd_per_dud_day", T.DoubleType()),
    ]
)
#: All rows sent for a slot: their ids, and their other columns one row after the other.
SENT = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("numbers", T.ArrayType(T.DoubleType()))])

Sent = Row(*SENT.names)


@contextmanager
def on_rocksdb(spark: SparkSession):
    """State of queries started inside lives in RocksDB, on the executors' disks with changelogs in the checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def prior_statistics(y: Sequence[float], x: Sequence[float]) -> Iterator[tuple[float | None, float | None]]:
    """Standard deviation of y and slope of y over x among all earlier entries, None where there are fewer than two or x
    does not vary. Prefix sums are centred at the first entry, so whole numbers stay exact. A history is short, so plain
    floats are faster than arrays."""
    sy = syy = sx = sxx = sxy = 0.0
    for n, (b, a) in enumerate(zip(y, x)):
        deviation = slope = None
        if n >= 2:
            deviation = math.sqrt(max(syy * n - sy * sy, 0.0)) / n
            spread = sxx * n - sx * sx
            slope = (sxy * n - sx * sy) / spread if spread else None
        yield (
            None if deviation is None or math.isnan(deviation) else deviation,
            slope if slope is not None and math.isfinite(slope) else None,
        )
        dy, dx = b - y[0], a - x[0]
        sy, syy, sx, sxx, sxy = sy + dy, syy + dy * dy, sx + dx, sxx + dx * dx, sxy + dx * dy


class SlotHistory(StatefulProcessor):
    """Keeps the offers of one slot; a repeated (time, batch) replaces what it said before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", EVENTS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kept = (self.events.get() or (b"",))[0]
        cuts = (kept[i : i + EVENT.size] for i in range(0, len(kept), EVENT.size))
        known = {PLACE.unpack_from(cut): cut for cut in cuts}
        fresh, departs = {}, None
        for *_, offer in rows:
            departs = offer["departs"] if departs is None else max(departs, offer["departs"] or departs)
            entry = EVENT.pack(offer["at"], offer["batch"], offer["row_id"], offer["y"], offer["x"])
            place = offer["at"], offer["batch"]
            if known.get(place) != entry:
                fresh[place] = entry
        if not fresh:
            return
        merged = {**known, **fresh}
        order = sorted(merged)
        packed = b"".join([merged[place] for place in order])
        self.events.update((packed,))
        if departs is not None and not known:
            self.handle.registerTimer(departs)
        _, _, row_ids, y, x = zip(*EVENT.iter_unpack(packed))
        first, numbers = order.index(min(fresh)), []
        for n, statistics in enumerate(prior_statistics(y, x)):
            if n >= first:
                numbers += (float(n), y[n - 1] if n else None, *statistics)
        yield Sent(list(row_ids[first:]), numbers)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_history(
    stream: DataFrame,
    keys: Sequence[str] = ("schedule_slot_id",),
    row_id: str = "offer_id",
    time: str = "feature_time",
    batch: str = "session_key",
    value: str = "price_vnd",
    over: str = "days_until_departure",
    departs: str = "departure_time",
    delay: str = DELAY,
) -> DataFrame:
    """Strictly prior count, last fare, volatility and trend of every offer that is new or behind a new one.

    Rows that arrive up to ``delay`` behind the newest event time correct the rows after them; what is later than that
    is dropped by the watermark and left to the batch job. Take the newest version of a row (``latest_version``). Start
    the query inside ``on_rocksdb``. Rows without key, time or id are ignored, null fares must be cleaned before; a null
    departure keeps the state of its slot.
    """
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    events = timed.where(F.col("__t").isNotNull() & F.col(row_id).isNotNull() & F.col(keys[0]).isNotNull()).select(
        *keys,
        "__t",
        F.struct(
            F.unix_micros("__t").alias("at"),
            F.coalesce(F.col(batch).cast("long"), F.lit(NO_BATCH)).alias("batch"),
            F.col(row_id).cast("long").alias("row_id"),
            number(value).alias("y"),
            number(over).alias("x"),
            F.unix_millis(F.col(departs).cast("timestamp")).alias("departs"),
        ).alias("offer"),
    )
    sent = events.groupBy(*keys).transformWithState(SlotHistory(), SENT, "Update", "EventTime")
    first, *others = OUTPUT.fields
    at = lambda i: F.get("numbers", F.col("i") * len(others) + i)
    laid_out = sent.select(F.posexplode("ids").alias("i", first.name), "numbers")
    return laid_out.select(first.name, *[at(i).cast(field.dataType).alias(field.name) for i, field in enumerate(others)])
