"""A store of collection batches in immutable versions, published one at a time.

Layout below the root::

    data/folder=<version>-<random>/session_date=.../session_label=...   offers of the batches promoted in that version
    manifest/<version>/batches, registry                                one row per batch; pairs of route and airline

A version's offers and manifest are written under names that nobody reads, then the manifest folder gets its number by
one rename. Readers take the highest number, so they see the old state or the new one; a crash before the rename leaves
files without a reference, which ``vacuum`` removes. The manifest has two rows a day.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farepanel.functions import columns as K
from farepanel.operators import quality
from farepanel.operators.scale import join_on
from farepanel.session import checkpoint_root, names_in, publish, remove

BATCH = ("session_date", "session_label")
PAIR = ("route", "airline")
MANIFEST = T.StructType(
    [T.StructField("session_date", T.DateType()), T.StructField("session_label", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("status", "content_hash")]
    + [T.StructField("rows", T.LongType()), T.StructField("report", T.StringType()), T.StructField("version", T.LongType())]
    + [T.StructField("folder", T.StringType()), T.StructField("ready_hash", T.StringType()), T.StructField("ready_rows", T.LongType())]
)
REGISTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in PAIR] + [T.StructField(c, T.DateType()) for c in ("first_seen", "last_seen")]
)
FOLDER = T.StructField("folder", T.StringType())


def standard_offers(df: DataFrame) -> DataFrame:
    """Offers of the standard tier, the latest scrape of every slot in a batch; a given tier column is trusted."""
    tier = F.col("price_tier") if "price_tier" in df.columns else K.price_tier("price_vnd", "route")
    return quality.completed_batch_offers(df.where(tier == "standard"))


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint and row count of every collection batch."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*BATCH).agg(F.sum(row).cast("string").alias("content_hash"), F.count(F.lit(1)).alias("rows"))


def unknown_pairs(df: DataFrame, known: DataFrame) -> DataFrame:
    """Per batch the pairs of route and airline that the registry lacks, as text; batches without any are left out."""
    seen = df.groupBy(*BATCH, *PAIR).agg(F.count(F.lit(1)).alias("n"))
    odd = seen.join(known.select(*PAIR), list(PAIR), "left_anti")
    return odd.groupBy(*BATCH).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", *PAIR))), ", ").alias("unsupported_pairs"))


class OfferStore:
    """``check`` gives (batch, status, ...) for offers, its other columns go into the report. With ``enforce_registry``
    a batch with a pair that no promoted batch and no row of ``known`` has is refused; the first promoted batch of an
    empty registry founds it. ``clean`` turns arriving rows into the offers to keep."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        check: Callable[[DataFrame], DataFrame] | None = None,
        enforce_registry: bool = False,
        known: DataFrame | None = None,
        clean: Callable[[DataFrame], DataFrame] = standard_offers,
    ) -> None:
        self.spark, self.root = spark, root
        self.check, self.enforce_registry, self.known, self.clean = check, enforce_registry, known, clean

    # --- reading

    def versions(self) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.root}/manifest") if n.isdigit()]

    def manifest(self, version: str | None = None) -> DataFrame:
        """Newest state of every batch: what happened last, and the folder that serves its promoted offers, if any."""
        version = version or max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/{version}/batches")

    def registry(self) -> DataFrame:
        version = max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.root}/manifest/{version}/registry")

    def folders(self, manifest: DataFrame) -> list[str]:
        """Folders that hold promoted batches: at most one per batch of the calendar."""
        return [r.folder for r in manifest.where("folder IS NOT NULL").select("folder").distinct().collect()]

    def offers(self, schema: T.StructType, version: str | None = None) -> DataFrame:
        """Promoted offers of the newest, or of a given, version; batch columns prune partitions."""
        live = self.manifest(version).where("folder IS NOT NULL").select("folder", *BATCH)
        paths = [f"{self.root}/data/folder={name}" for name in self.folders(live)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, FOLDER])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.join(live, ["folder", *BATCH], "left_semi").select(*schema.names)

    # --- writing

    def write(self, df: DataFrame, batch_id: int = 0) -> None:
        """Replace every batch that has rows in ``df`` by exactly these rows, if they pass; a function for foreachBatch.

        A batch must arrive whole. Content equal to the last outcome changes nothing, so replays are harmless. A batch
        that fails keeps its promoted offers, and its report says why.
        """
        spark = self.spark
        known = self.manifest()
        work = f"{checkpoint_root(spark)}/arrived-{uuid.uuid4().hex}"
        df.write.parquet(f"{work}/raw")
        arrived = spark.read.parquet(f"{work}/raw")
        self.clean(arrived).write.parquet(f"{work}/clean")
        rows = spark.read.parquet(f"{work}/clean")
        judged = self._judged(arrived, rows).persist()
        before = known.select(*BATCH, F.struct("status", "content_hash", "report").alias("__before"))
        same = F.col("__before").eqNullSafe(F.struct("status", "content_hash", "report"))
        changed = join_on(judged, before, list(BATCH), "left").where(~same).drop("__before").persist()
        if not changed.isEmpty():
            self._publish(known, changed, rows)
        changed.unpersist()
        judged.unpersist()
        remove(spark, work)

    def _judged(self, arrived: DataFrame, rows: DataFrame) -> DataFrame:
        """(batch, status, content_hash, rows, report) of every batch that arrived."""
        out = arrived.select(*BATCH).distinct()
        out = join_on(out, content_hash(rows, [c for c in rows.columns if c not in BATCH]), list(BATCH), "left").na.fill({"rows": 0})
        report = []
        if self.check is None:
            passed = F.col("rows") > 0
        else:
            verdict = self.check(rows)
            report = [c for c in verdict.columns if c not in (*BATCH, "status", "rows")]
            out = join_on(out, verdict.select(*BATCH, F.col("status").alias("__gate"), *report), list(BATCH), "left")
            passed = F.coalesce(F.col("__gate") == "READY", F.lit(False))
        if self.enforce_registry:
            pairs = self._pairs(rows, out.where(passed))
            out = join_on(out, unknown_pairs(rows, pairs), list(BATCH), "left")
            passed, report = passed & F.col("unsupported_pairs").isNull(), [*report, "unsupported_pairs"]
        status = F.when(passed, "READY").otherwise("FAILED")
        text = F.to_json(F.struct(*report)) if report else F.lit(None).cast("string")
        return out.select(*BATCH, status.alias("status"), "content_hash", "rows", text.alias("report"))

    def _pairs(self, rows: DataFrame, passing: DataFrame) -> DataFrame:
        """Known pairs; while there are none, those of the first batch that passes, which founds the registry."""
        pairs = self.registry().select(*PAIR)
        if self.known is not None:
            pairs = pairs.unionByName(self.known.select(*PAIR)).distinct()
        if not pairs.isEmpty():
            return pairs
        first = passing.select(*BATCH).orderBy(*BATCH).limit(1)
        return rows.join(first, list(BATCH), "left_semi").select(*PAIR).distinct()

    def _publish(self, known: DataFrame, changed: DataFrame, rows: DataFrame) -> None:
        spark = self.spark
        version = int(max(self.versions(), default="0")) + 1
        folder = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        ready = changed.where("status = 'READY'").select(*BATCH)
        promoted = rows.join(ready, list(BATCH), "left_semi")
        promoted.hint("rebalance", *BATCH).write.partitionBy(*BATCH).parquet(f"{self.root}/data/folder={folder}")
        old = known.select(*BATCH, *[F.col(c).alias(f"__{c}") for c in ("folder", "ready_hash", "ready_rows")])
        is_ready = F.col("status") == "READY"
        fresh = join_on(changed, old, list(BATCH), "left").select(
            *changed.columns,
            F.lit(version).cast("bigint").alias("version"),
            F.when(is_ready, F.lit(folder)).otherwise(F.col("__folder")).alias("folder"),
            F.when(is_ready, F.col("content_hash")).otherwise(F.col("__ready_hash")).alias("ready_hash"),
            F.when(is_ready, F.col("rows")).otherwise(F.col("__ready_rows")).alias("ready_rows"),
        )
        states = known.join(changed, list(BATCH), "left_anti").unionByName(fresh)
        prior = self.registry()
        if self.known is not None:  # never seen in the store itself: without dates
            prior = prior.unionByName(self.known.select(*PAIR), allowMissingColumns=True)
        self._rename(version, states, quality.registry(promoted, prior))

    def _rename(self, version: int, states: DataFrame, registry: DataFrame) -> None:
        staging = f"{self.root}/manifest/_staging-{uuid.uuid4().hex}"
        # repartition, not coalesce: one task would run the joins of all partitions and hold the buffers of their sorts together
        states.select(*MANIFEST.names).repartition(1).write.json(f"{staging}/batches")
        registry.repartition(1).write.parquet(f"{staging}/registry")
        publish(self.spark, staging, f"{self.root}/manifest/{version:08d}")

    # --- upkeep

    def compact(self, schema: T.StructType) -> None:
        """Copy all promoted offers into one folder of a new version, so that readers open few folders."""
        version = int(max(self.versions(), default="0")) + 1
        folder = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        self.offers(schema).hint("rebalance", *BATCH).write.partitionBy(*BATCH).parquet(f"{self.root}/data/folder={folder}")
        states = self.manifest().withColumn("folder", F.when(F.col("folder").isNotNull(), F.lit(folder)))
        self._rename(version, states, self.registry())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests before the newest ``keep`` and data folders that no kept one names. Run it while no writer
        is at work: a version on its way has no manifest yet."""
        versions = self.versions()
        kept = versions[-keep:]
        live = {f"folder={name}" for version in kept for name in self.folders(self.manifest(version))}
        stale = [f"data/{n}" for n in names_in(self.spark, f"{self.root}/data") if n not in live and not n.startswith("_")]
        stale += [f"manifest/{n}" for n in names_in(self.spark, f"{self.root}/manifest") if n not in kept]
        for name in stale:
            remove(self.spark, f"{self.root}/{name}")
        return stale
