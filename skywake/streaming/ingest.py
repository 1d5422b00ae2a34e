"""The ingestion cycle as a stream: parse, upsert, keep the counts, log."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators import anomalies, maintenance
from skywake.sources.snapshots import parse_states, stream_state_snapshots, valid_states
from skywake.sources.tables import BUCKETS, BatchLog, Store, drop_expired_hours, write_history

PRODUCTION_TRIGGER = {"processingTime": "180 seconds"}
FUTURE = "future_time"


def arrival() -> list[Column]:
    """Of several vectors for one aircraft and time, that of the file landed last counts."""
    return [F.desc("landed"), F.desc("file"), F.desc("position")]


def bounded(parsed: DataFrame) -> DataFrame:
    """Rows with their cycle: the time of their snapshot, or its landing where that time lies ahead of it.

    A snapshot dated ahead by more than the tolerance is rejected whole and moves no clock: it is logged, but its landing is
    no cycle and bounds none.
    """
    landed = F.unix_seconds("landed")
    ahead = F.col("time") > landed + int(K.CLOCK_TOLERANCE.total_seconds())
    reason = F.when(ahead, FUTURE).otherwise(F.col("reject_reason"))
    return parsed.withColumn("cycle", F.when(ahead, landed).otherwise(F.col("time"))).withColumn("reject_reason", reason)


def accept(parsed: DataFrame) -> DataFrame:
    """Valid rows of `bounded` with the snapshot time as their ingest time."""
    return valid_states(parsed).withColumn("ingested_at", F.timestamp_seconds("time").cast("timestamp_ntz"))


def run_cycle(vectors: DataFrame, batch: int, store: Store) -> None:
    """The cycles of a micro-batch, one for each snapshot time in it, however many there are.

    The vectors are parsed once, into the log of observations, which all else reads. The reference time is the newest accepted
    snapshot, not the wall clock, so that a replay gives the same result. Everything a batch writes overwrites what it wrote
    before, but for the counts: they follow from the live table before the batch, so once they are there they stay.
    """
    clock = time.monotonic()
    lap = lambda: int((time.monotonic() - clock) * 1000)
    newest, accepted = None, F.col("reject_reason").isNull()
    try:
        seen = Observation()
        parsed = bounded(parse_states(vectors))
        measured = parsed.observe(seen, F.count_if(accepted).alias("accepted"), F.max(F.when(accepted, F.col("time"))).alias("newest"))
        observed = store.observed.write(batch, measured)
        fetched = lap()
        if seen.get["accepted"]:
            newest = datetime.fromtimestamp(seen.get["newest"], timezone.utc).replace(tzinfo=None)
            merged = store.live.merged(accept(observed), arrival()).persist()
            try:
                if batch not in store.counts.batches():
                    store.counts.write(batch, maintenance.applied(counts_before(store, batch), merged, newest))
                store.live.store(merged, newest)
            finally:
                merged.unpersist()
        store.runs.write(batch, cycle_runs(observed, fetched, lap() - fetched))
        store.drop_expired()
    except Exception as error:
        try:
            as_of = newest or datetime.now(timezone.utc).replace(tzinfo=None)
            store.failures.write(batch, failed_run(vectors.sparkSession, as_of, batch, lap(), str(error)))
        except Exception as second:
            error.add_note(f"The failed run could not be logged: {second}")
        raise


def counts_before(store: Store, batch: int) -> DataFrame:
    """The counts of the newest batch before this one."""
    known = [b for b in store.counts.batches() if b < batch]
    return store.counts.of(known[-1] if known else -1)


def cycle_runs(observed: DataFrame, fetch_ms: int, upsert_ms: int) -> DataFrame:
    """A run log row for each cycle of a batch, numbered by its time; one without an accepted row is an error.

    The times are those measured for the batch, in equal parts for its cycles.
    """
    counted = observed.groupBy("cycle").agg(
        F.count_if(F.col("reject_reason").isNull()).cast("int").alias("n"),
        F.bool_and(F.col("reject_reason").eqNullSafe(FUTURE)).alias("ahead"),
    )
    ok, cycles = F.col("n") > 0, counted.agg(F.count("*")).scalar()
    share = lambda ms: F.ceil(F.lit(ms) / cycles).cast("int")
    return counted.select(
        F.col("cycle").alias("id"),
        F.timestamp_seconds("cycle").cast("timestamp_ntz").alias("run_at"),
        F.col("n").alias("records_fetched"),
        F.col("n").alias("records_upserted"),
        share(fetch_ms).alias("fetch_ms"),
        F.when(ok, share(upsert_ms)).otherwise(F.lit(0)).alias("upsert_ms"),
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(F.col("ahead"), K.FUTURE_MESSAGE).when(~ok, K.EMPTY_FETCH_MESSAGE).alias("error_msg"),
    )


def failed_run(spark: SparkSession, as_of: datetime, run_id: int, spent_ms: int, error: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("id"),
        S.moment(as_of).alias("run_at"),
        F.lit(0).alias("records_fetched"),
        F.lit(0).alias("records_upserted"),
        F.lit(0).alias("fetch_ms"),
        F.lit(spent_ms).alias("upsert_ms"),
        F.lit("error").alias("status"),
        F.lit(error).alias("error_msg"),
    )


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    max_files: int | None = None,
    multi_line: bool = False,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Run the cycle on every batch of files landing in a folder, by default once over what is there.

    In production pass ``trigger=PRODUCTION_TRIGGER``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    vectors = stream_state_snapshots(spark, landing, multi_line, max_files)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        run_cycle(batch, batch_id, Store(batch.sparkSession, root, buckets))

    return (
        vectors.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_history(
    spark: SparkSession,
    landing: str,
    path: str,
    checkpoint: str,
    max_files: int | None = None,
    multi_line: bool = False,
    trigger: dict | None = None,
    keep: timedelta | None = K.HISTORY_RETENTION,
    sketches: BatchLog | None = None,
) -> StreamingQuery:
    """Append the airborne rows to the history log, each batch once, and drop the hours past retention.

    With ``sketches`` each batch leaves a sketch of each hour it has rows of, which outlives the rows.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    vectors = stream_state_snapshots(spark, landing, multi_line, max_files)

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = accept(bounded(parse_states(batch)))
        write_history(rows, batch_id, path)
        if sketches is not None:
            log = BatchLog(batch.sparkSession, sketches.path, sketches.schema)
            log.write(batch_id, anomalies.hourly_sketches(rows))
        as_of = rows.agg(F.max("ingested_at")).first()[0] if keep is not None else None
        if as_of is not None:
            drop_expired_hours(batch.sparkSession, path, as_of, keep)

    return (
        vectors.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
