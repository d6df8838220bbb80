"""The store of collection batches: replacement, gates, crashes, versions; and history under late arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from farepanel.operators import history, quality
from farepanel.session import names_in
from farepanel.streaming import ingest, state, store

STORE = "schedule_slot_id long, session_key int, session_id timestamp_ntz, scraped_at timestamp_ntz, route string, airline string, days_until_departure int, price_vnd long, session_date date, session_label string"
ROUTE = "SGN-HAN"


def arrivals(spark, prices, day=1, minute=0, airline="VN", label="AM"):
    at = dt.datetime(2026, 5, day, 8, minute)
    rows = [(slot, day, dt.datetime(2026, 5, day, 8), at, ROUTE, airline, 7, price, dt.date(2026, 5, day), label) for slot, price in prices.items()]
    return spark.createDataFrame(rows, STORE)


def content(kept, version=None):
    return {(r.session_date.day, r.schedule_slot_id): r.price_vnd for r in kept.offers(kept.spark.createDataFrame([], STORE).schema, version).collect()}


def states(kept):
    return {r.session_date.day: r.status for r in kept.manifest().collect()}


def at_least(n):
    """A gate that wants n slots a batch."""
    return lambda df: df.groupBy(*store.BATCH).agg(F.when(F.count(F.lit(1)) >= n, "READY").otherwise("FAILED").alias("status"), F.count(F.lit(1)).alias("slots"))


def test_a_batch_is_replaced_not_merged(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path))
    kept.write(arrivals(spark, {1: 10, 2: 20, 3: 30}))
    kept.write(arrivals(spark, {1: 11, 2: 20}, minute=9))  # slot 3 withdrawn, slot 1 corrected
    assert content(kept) == {(1, 1): 11, (1, 2): 20}
    kept.write(arrivals(spark, {7: 70}, day=2))
    assert content(kept) == {(1, 1): 11, (1, 2): 20, (2, 7): 70}
    assert content(kept, kept.versions()[0]) == {(1, 1): 10, (1, 2): 20, (1, 3): 30}  # old versions stay readable


def test_manifest_is_gathered_by_an_exchange(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.json

    def json(writer, path, *args, **options):
        plans.append(writer._df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0])
        return write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "json", json)
    kept = store.OfferStore(spark, str(tmp_path))
    kept.write(arrivals(spark, {1: 10, 2: 20}))
    kept.write(arrivals(spark, {1: 11, 2: 20}, minute=9))
    assert plans == ["Repartition 1, true"] * 2
    assert content(kept) == {(1, 1): 11, (1, 2): 20}


def test_a_failed_replay_keeps_the_promoted_offers(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path), at_least(2))
    kept.write(arrivals(spark, {1: 10, 2: 20}))
    kept.write(arrivals(spark, {1: 99}))
    row = kept.manifest().first()
    assert (row.status, row.rows, row.ready_rows, row.report) == ("FAILED", 1, 2, '{"slots":1}')
    assert content(kept) == {(1, 1): 10, (1, 2): 20}
    kept.write(arrivals(spark, {1: 99, 2: 20}))  # the bad delivery leaves no trace in the next one
    assert content(kept) == {(1, 1): 99, (1, 2): 20} and states(kept) == {1: "READY"}


def test_a_replay_changes_nothing(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path), at_least(2))
    for df in (arrivals(spark, {1: 10, 2: 20}), arrivals(spark, {5: 50}, day=2)) * 2:
        kept.write(df)
    assert kept.versions() == ["00000001", "00000002"] and states(kept) == {1: "READY", 2: "FAILED"}
    kept.write(arrivals(spark, {}))
    assert len(kept.versions()) == 2


def test_tiers_and_repeats_are_cleaned_before_the_gate(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path), at_least(2))
    rows = arrivals(spark, {1: 10, 2: 9_000_000}).unionByName(arrivals(spark, {1: 12}, minute=5)).unionByName(arrivals(spark, {1: 8_000_000}, minute=7))
    kept.write(rows)
    assert states(kept) == {1: "FAILED"}  # one standard slot only
    kept.write(rows.unionByName(arrivals(spark, {3: 30})))
    assert content(kept) == {(1, 1): 12, (1, 3): 30}  # the latest standard scrape, not the later dear one
    kept.write(arrivals(spark, {2: 9_000_000}, day=2))
    assert states(kept) == {1: "READY", 2: "FAILED"}


def test_registry_stops_unsupported_pairs(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path), enforce_registry=True)
    kept.write(arrivals(spark, {1: 10}, day=2).unionByName(arrivals(spark, {1: 10}, day=3, airline="VJ")))
    assert states(kept) == {2: "READY", 3: "FAILED"}  # the first batch founds the registry
    assert "SGN-HAN/VJ" in kept.manifest().where("status = 'FAILED'").first().report
    known = spark.createDataFrame([(ROUTE, "VJ")], "route string, airline string")
    wider = store.OfferStore(spark, str(tmp_path), enforce_registry=True, known=known)
    wider.write(arrivals(spark, {1: 10}, day=3, airline="VJ"))
    assert states(wider) == {2: "READY", 3: "READY"}
    wider.write(arrivals(spark, {1: 10}, day=1))
    seen = {r.airline: (r.first_seen.day, r.last_seen.day) for r in wider.registry().collect()}
    assert seen == {"VN": (1, 2), "VJ": (3, 3)}


def test_a_crash_before_the_rename_shows_the_old_version(spark, tmp_path, monkeypatch):
    kept = store.OfferStore(spark, str(tmp_path))
    kept.write(arrivals(spark, {1: 10}))

    def crash(*args):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "publish", crash)
        with pytest.raises(OSError):
            kept.write(arrivals(spark, {1: 11}))
    assert content(kept) == {(1, 1): 10} and len(names_in(spark, f"{tmp_path}/data")) == 2
    kept.write(arrivals(spark, {1: 11}))
    assert content(kept) == {(1, 1): 11} and len(kept.versions()) == 2
    gone = kept.vacuum(keep=1)
    assert sum(n.startswith("data/") for n in gone) == 2 and content(kept) == {(1, 1): 11}
    assert kept.vacuum(keep=1) == []


def test_two_writers_cannot_publish_the_same_version(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path))
    kept.write(arrivals(spark, {1: 10}))
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        kept._rename(1, kept.manifest(), kept.registry())
    assert content(kept) == {(1, 1): 10}


def test_compaction_keeps_content_and_prunes_partitions(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path))
    for day in (1, 2, 3):
        kept.write(arrivals(spark, {day: day}, day=day))
    before, schema = content(kept), arrivals(spark, {1: 1}).schema
    kept.compact(schema)
    kept.vacuum(keep=1)
    assert content(kept) == before and len(names_in(spark, f"{tmp_path}/data")) == 1
    plan = kept.offers(schema).where("session_date = date '2026-05-02'")._jdf.queryExecution().executedPlan().toString()
    assert "2026-05-02" in plan[plan.index("PartitionFilters") :].split("]")[0]


def test_an_empty_store(spark, tmp_path):
    kept = store.OfferStore(spark, str(tmp_path / "none"))
    assert kept.manifest().collect() == [] and kept.registry().collect() == [] and content(kept) == {} and kept.vacuum() == []


# --- history --------------------------------------------------------------------------------


def offers(spark, rows):
    base = dt.datetime(2026, 5, 1)
    full = [(i, slot, base + dt.timedelta(hours=12 * b), b, price, 60 - b // 2, base + dt.timedelta(days=40)) for i, (slot, b, price) in enumerate(rows)]
    schema = "offer_id long, schedule_slot_id long, feature_time timestamp_ntz, session_key int, price_vnd long, days_until_departure int, departure_time timestamp_ntz"
    return spark.createDataFrame(full, schema)


def run(spark, tmp_path, drops, delay="400 days", out="out"):
    for i, df in enumerate(drops):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        with state.on_rocksdb(spark):
            query = (
                state.stateful_history(stream, delay=delay).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp")
                .trigger(availableNow=True).foreachBatch(ingest.changelog_writer(f"{tmp_path}/{out}")).start()
            )
            query.awaitTermination()
    return query


def expected(df):
    full = history.schedule_history(df.withColumns({"collection_era": F.lit("E"), "session_label": F.lit("AM")}), by_era=False, relative=False)
    rows = full.select(*state.OUTPUT.names).collect()
    return {r[0]: tuple(None if v is None else round(float(v), 6) for v in r[1:]) for r in rows}


def newest(spark, tmp_path):
    rows = ingest.latest_version(spark, f"{tmp_path}/out", ["offer_id"]).collect()
    return {r[0]: tuple(None if v is None else round(float(v), 6) for v in r[1:]) for r in rows}


def test_shuffled_arrival_equals_the_batch_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(slot, b, rng.randint(500_000, 3_000_000)) for slot in range(12) for b in rng.sample(range(40), rng.randint(1, 15))]
    rng.shuffle(rows)
    df = offers(spark, rows)
    parts = [df.where(F.col("offer_id") % 4 == i) for i in range(4)]
    run(spark, tmp_path, [*parts, parts[1]])  # the last drop is a replay
    assert newest(spark, tmp_path) == expected(df)
    log = spark.read.parquet(f"{tmp_path}/out")
    assert log.where(f"batch_id = {log.agg(F.max('batch_id')).first()[0]}").count() < df.count()
    assert log.groupBy("offer_id", "batch_id").count().where("count > 1").count() == 0


def test_a_late_offer_corrects_only_what_follows(spark, tmp_path):
    rows = [(1, 0, 100), (1, 2, 300), (1, 3, 500), (2, 2, 7)]
    late = offers(spark, rows + [(1, 1, 900)]).where("offer_id = 4")
    run(spark, tmp_path, [offers(spark, rows), late])
    log = spark.read.parquet(f"{tmp_path}/out")
    last = log.agg(F.max("batch_id")).first()[0]
    second = {r.offer_id: (r.prior_observation_count, r.previous_price_same_schedule) for r in log.where(f"batch_id = {last}").collect()}
    assert second == {4: (1, 100.0), 1: (2, 900.0), 2: (3, 300.0)}


def test_state_ends_after_departure(spark, tmp_path):
    base = dt.datetime(2026, 5, 1)
    schema = offers(spark, [(1, 0, 1)]).schema
    day = lambda i, slot, days, leaves: (i, slot, base + dt.timedelta(days=days), days, 100 + i, 9, base + dt.timedelta(days=leaves))
    drops = [[day(0, 1, 0, 2), day(1, 2, 0, 90)], [day(2, 2, 30, 90)], [day(3, 2, 31, 90)], [day(4, 2, 32, 90)]]
    query = run(spark, tmp_path, [spark.createDataFrame(rows, schema) for rows in drops], "3 days")
    totals = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert totals and totals[-1] > 0
    slots = spark.read.format("statestore").option("stateVarName", "events").load(f"{tmp_path}/cp").select("key.schedule_slot_id").distinct()
    assert [r[0] for r in slots.collect()] == [2]  # slot 1 left long before the watermark
    assert newest(spark, tmp_path)[4][0] == 3


class Counted:
    """State of one slot and its handle; every call of the processor is a round trip to the JVM."""

    def __init__(self):
        self.kept, self.calls, self.timers = [], [], []

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.kept[0] if self.kept else None
            if name == "registerTimer":
                self.timers += args
            elif name == "clear":
                self.kept = []
            else:
                self.kept = list(args)

        return call


def test_a_slot_costs_one_read_one_write_and_one_row_out():
    handle, processor = Counted(), state.SlotHistory()
    processor.init(handle)

    def visit(*offers):
        handle.calls.clear()
        rows = [("slot", None, dict(at=at, batch=at, row_id=at, y=float(y), x=x, departs=99)) for at, y, x in offers]
        return [(r.ids, r.numbers) for r in processor.handleInputRows(("slot",), iter(rows), None)], list(handle.calls)

    missing = float("nan")
    assert visit((1, 100, 9.0), (3, 300, 7.0), (4, 500, missing)) == ([([1, 3, 4], [0.0, None, None, None, 1.0, 100.0, None, None, 2.0, 300.0, 100.0, -100.0])], ["get", "update", "registerTimer"])
    sent, calls = visit((2, 200, 8.0))
    assert calls == ["get", "update"] and handle.timers == [99]
    assert sent == [([2, 3, 4], [1.0, 100.0, None, None, 2.0, 200.0, 50.0, -100.0, 3.0, 300.0, pytest.approx((20000 / 3) ** 0.5), -100.0])]
    assert visit((3, 300, 7.0), (4, 500, missing)) == ([], ["get"])  # a replay is neither written nor sent
    assert visit((4, 600, 6.0))[0] == [([4], [3.0, 300.0, pytest.approx((20000 / 3) ** 0.5), -100.0])]
    list(processor.handleExpiredTimer(("slot",), None, None))
    assert visit((5, 1, 1.0)) == ([([5], [0.0, None, None, None])], ["get", "update", "registerTimer"])
