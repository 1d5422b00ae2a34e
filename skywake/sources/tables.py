"""The tables of the streams, kept by Spark's own means: Parquet folders, partition overwrite, buckets.

Logs are folders by batch. A batch overwrites its own folder, so running it again changes nothing, and what several batches wrote
about one thing is put together when it is read. The live table is hashed into buckets, one folder each: an upsert
overwrites the folders of the buckets it touches and leaves all others alone.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta
from functools import cached_property, reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skywake import constants as K, schemas
from skywake.functions import geo
from skywake.operators import positions, snapshots
from skywake.sources import files

BUCKETS = 64
#: How long parsed vectors are kept for the streams that follow them.
OBSERVED_RETENTION = timedelta(days=1)


def overwrite_parts(rows: DataFrame, path: str, *by: str) -> None:
    """Replace just the folders of a table that `rows` has values for (an action)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class BatchLog:
    """A table in folders by batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, batch: int, rows: DataFrame) -> DataFrame:
        """Store the rows of a batch, and return them as stored."""
        overwrite_parts(rows.select(*self.schema.fieldNames()).withColumn("batch", F.lit(batch)), self.path, "batch")
        return self.of(batch)

    def batches(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in files.names(self.spark, self.path) if n.startswith("batch="))

    def of(self, batch: int) -> DataFrame:
        folder = f"{self.path}/batch={batch}"
        known = files.exists(self.spark, folder)
        return self.spark.read.schema(self.schema).parquet(folder) if known else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows, with their batch."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        known = files.exists(self.spark, self.path)
        return self.spark.read.schema(schema).parquet(self.path) if known else self.spark.createDataFrame([], schema)

    def drop(self, batches: list[int]) -> None:
        for batch in batches:
            files.remove(self.spark, f"{self.path}/batch={batch}")


class LiveTable:
    """The latest row of each aircraft, in as many hash buckets as it was made with.

    The folder of a bucket holds the one file of that bucket, so Spark reads the table as already distributed by address: a join with
    it moves the other side alone.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"live_{hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()}"

    @cached_property
    def _made(self) -> str:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.LIVE)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, slot INT) USING parquet PARTITIONED BY (slot) "
            f"CLUSTERED BY (icao24) INTO {self.buckets} BUCKETS LOCATION '{self.path}' OPTIONS (partitionOverwriteMode 'dynamic')"
        )
        return self.name

    def slot(self) -> Column:
        """The bucket of an address, by the hash that Spark buckets with."""
        return F.pmod(F.hash("icao24"), F.lit(self.buckets))

    def rows(self) -> DataFrame:
        """All stored rows with their slot, also those past retention."""
        self.spark.catalog.refreshTable(self._made)
        return self.spark.table(self.name)

    def current(self) -> DataFrame:
        """The rows within retention of the newest one."""
        rows = self.rows().drop("slot")
        return snapshots.purge_stale_live(rows, rows.agg(F.max("ingested_at")).scalar())

    def merged(self, batch: DataFrame, newest_first: list[Column]) -> DataFrame:
        """icao24, old and new (the rows before and after) and slot, for all rows of the buckets that `batch` touches.

        A row never replaces one ingested later. Which buckets are touched is a list of at most their number.
        """
        chosen = snapshots.latest_by_key(batch, ["icao24"], [F.desc("ingested_at"), *newest_first])
        touched = sorted(row[0] for row in batch.select(self.slot()).distinct().collect())
        row = F.struct(*schemas.LIVE_COLUMNS)
        stored = self.rows().where(F.col("slot").isin(touched)).select("icao24", row.alias("old"))
        both = stored.join(chosen.select("icao24", row.alias("came")), "icao24", "full_outer")
        wins = F.col("old").isNull() | (F.col("came.ingested_at") >= F.col("old.ingested_at"))
        return both.select("icao24", "old", F.when(wins, F.col("came")).otherwise(F.col("old")).alias("new"), self.slot().alias("slot"))

    def store(self, merged: DataFrame, as_of: datetime) -> None:
        """Overwrite the buckets of `merged` without what is past retention at `as_of` (an action)."""
        rows = snapshots.purge_stale_live(merged.select("new.*", "slot"), as_of)
        rows.write.insertInto(self._made, overwrite=True)


class Store:
    """The tables that the ingestion cycle and the streams behind it keep below a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        root = root.rstrip("/")
        self.spark, self.root = spark, root
        self.observed = BatchLog(spark, f"{root}/observed", schemas.OBSERVED)
        self.runs = BatchLog(spark, f"{root}/runs", schemas.RUNS)
        self.failures = BatchLog(spark, f"{root}/failures", schemas.RUNS)
        self.counts = BatchLog(spark, f"{root}/counts", schemas.COUNTS)
        self.live = LiveTable(spark, f"{root}/live", buckets)
        self.signals = f"{root}/signals"

    def run_log(self) -> DataFrame:
        """All runs within retention, failed batches included."""
        runs = merged_runs(self.runs.read().drop("batch")).unionByName(self.failures.read().drop("batch"))
        return snapshots.purge_runs(runs, runs.agg(F.max("run_at")).scalar())

    def current_counts(self) -> DataFrame:
        """The counts of the newest batch."""
        known = self.counts.batches()
        return self.counts.of(known[-1]) if known else self.counts.read().drop("batch")

    def drop_expired(self) -> None:
        """Drop the batches whose runs are all past retention, and counts long superseded."""
        last = self.runs.read().groupBy("batch").agg(F.max("run_at").alias("run_at"))  # a row a batch
        ends = {row.batch: row.run_at for row in last.collect()}
        if ends:
            newest = max(ends.values())
            for log, keep in ((self.runs, K.RUN_RETENTION), (self.failures, K.RUN_RETENTION), (self.observed, OBSERVED_RETENTION)):
                log.drop([b for b in log.batches() if ends.get(b, newest) < newest - keep])
        self.counts.drop(self.counts.batches()[:-2])


def merged_runs(runs: DataFrame) -> DataFrame:
    """The log with a row for each run; parts of one snapshot that came in several batches are one run."""
    ahead = F.col("error_msg").eqNullSafe(K.FUTURE_MESSAGE)
    merged = runs.groupBy("id", "run_at").agg(
        *(F.sum(c).cast("int").alias(c) for c in ("records_fetched", "records_upserted", "fetch_ms", "upsert_ms")),
        F.max("status").alias("status"),  # 'success' comes behind 'error'
        F.bool_and(ahead).alias("ahead"),  # a landing can be the time of a snapshot as well
    )
    message = F.when(F.col("ahead"), K.FUTURE_MESSAGE).when(F.col("status") == "error", K.EMPTY_FETCH_MESSAGE)
    return merged.withColumn("error_msg", message).drop("ahead")


#: Row groups of stored logs and tables: small enough that a lookup skips most of a file.
ROW_GROUP_BYTES = 16 << 20
#: Addresses that a row group's Bloom filter is laid out for.
ADDRESSES = 100_000


def write_history(batch: DataFrame, batch_id: int, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store the airborne rows of a micro-batch, in folders by hour and batch (an action).

    A batch replaces just its own folders, so that writing it again changes nothing. ``rebalance`` splits an
    hour that holds much of the batch into several files. Files are in the order of the address and have Bloom filters of it, so
    that who asks for one aircraft reads the folders of its hours, and of them the row groups that can hold it.
    """
    rows = snapshots.history_rows(batch).withColumn("batch", F.lit(batch_id)).hint("rebalance", "ingest_hour")
    options = {
        "partitionOverwriteMode": "dynamic",
        "parquet.block.size": row_group_bytes,
        "parquet.bloom.filter.enabled#icao24": True,
        "parquet.bloom.filter.expected.ndv#icao24": ADDRESSES,
    }
    ordered = rows.sortWithinPartitions("ingest_hour", "batch", "icao24", "ingested_at")
    ordered.write.mode("overwrite").options(**options).partitionBy("ingest_hour", "batch").parquet(path)


def write_by_place(rows: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store rows with a position along the Z curve, neighbours in the same files and row groups (an action)."""
    placed = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("place", geo.z_order(F.col("lat"), F.col("lon")))
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place")
    ordered.write.option("parquet.block.size", row_group_bytes).parquet(path)


def in_view(stored: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """``positions.bbox_filter`` over a table that ``write_by_place`` stored: it reads the row groups of the stretches that cover the box.

    A box over the date line is two boxes, as there.
    """
    stretches = [F.col("place").between(first, last) for first, last in geo.z_ranges(south, west, north, east)]
    near = stored.where(reduce(lambda a, b: a | b, stretches, F.lit(False)))
    return positions.bbox_filter(near, south, west, north, east).drop("place")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The log, with the hour as a column that prunes folders."""
    hour = T.StructField("ingest_hour", T.TimestampNTZType())
    return spark.read.schema(T.StructType([*schemas.LIVE.fields, hour])).parquet(path)


def drop_expired_hours(spark: SparkSession, path: str, as_of: datetime, keep: timedelta) -> None:
    """Delete the folders of hours that ended more than ``keep`` before ``as_of``; no file is read."""
    prefix = "ingest_hour="
    for name in files.names(spark, path):
        if name.startswith(prefix):
            start = datetime.fromisoformat(unquote(name.removeprefix(prefix)))
            if start + timedelta(hours=1) <= as_of - keep:
                files.remove(spark, f"{path}/{name}")
