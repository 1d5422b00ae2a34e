"""Keeping the live table: latest row per key, upsert, retention, run log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.schemas import LIVE_COLUMNS


def latest_by_key(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row of each key.

    Spark cuts each map task's rows to one per key before the shuffle (the row limit reaches below the
    exchange), so a key holding a third of all rows sends one row per map task. Columns nobody reads are
    pruned from the scan and the shuffle, which a ``max_by`` over a whole-row struct would prevent.
    """
    window = W.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def snapshot_at(history: DataFrame, as_of: Column | datetime, newest_first: list[Column]) -> DataFrame:
    """The live table as it stood at a moment."""
    known = history.where(F.col("ingested_at") <= S.moment(as_of))
    return latest_by_key(known, ["icao24"], newest_first)


def snapshots_at(history: DataFrame, moments: list[Column], newest_first: list[Column]) -> DataFrame:
    """The live table at each of a few ascending moments, with the moment as ``cycle``, from one pass over the log.

    A row's first cycle is found by counting the moments before it. The log is cut to the newest row per aircraft and first
    cycle, in the map tasks already; only those few rows are then repeated for the cycles until the aircraft's next one. The
    plan has an expression per moment; many of them are a matter for ``snapshots_on_grid``.
    """
    first = sum(((moment < F.col("ingested_at")).cast("int") for moment in moments), F.lit(0))
    marked = history.withColumn("_first", first).where(F.col("_first") < len(moments))
    return _lasting(marked, F.array(*moments), newest_first)


def snapshots_on_grid(history: DataFrame, last: Column, interval: timedelta, count: int, newest_first: list[Column]) -> DataFrame:
    """The same at ``count`` moments ``interval`` apart that end at ``last``; a row's first cycle follows by arithmetic."""
    step = int(interval.total_seconds() * 1_000_000)
    ago = F.unix_micros(last.cast("timestamp")) - F.unix_micros(F.col("ingested_at").cast("timestamp"))
    first = F.greatest(F.lit(0), F.lit(count - 1) - F.floor(ago / F.lit(step))).cast("int")
    marked = history.where(F.col("ingested_at") <= last).withColumn("_first", first)
    return _lasting(marked, cycle_grid(last, interval, count), newest_first)


def cycle_grid(last: Column, interval: timedelta, count: int) -> Column:
    """``count`` moments ``interval`` apart that end at ``last``, as an array."""
    return F.sequence(last - F.lit(interval * (count - 1)), last, F.lit(interval))


def _lasting(marked: DataFrame, moments: Column, newest_first: list[Column]) -> DataFrame:
    newest = latest_by_key(marked, ["icao24", "_first"], newest_first)
    following = F.lead("_first").over(W.partitionBy("icao24").orderBy("_first"))
    cycles = F.coalesce(following, F.size(moments)) - F.col("_first")
    lasting = newest.withColumn("_cycles", F.slice(moments, F.col("_first") + 1, cycles))
    return lasting.withColumn("cycle", F.explode("_cycles")).drop("_first", "_cycles")


def upsert_live(
    live: DataFrame, batch: DataFrame, newest_first: list[Column], ingested_at: Column | datetime | None = None
) -> DataFrame:
    """Replace whole rows of ``live`` by the rows of ``batch`` with the same address, and add new ones.

    Nulls of the batch overwrite. Of several rows for one address the first in ``newest_first`` wins. With
    ``ingested_at`` the whole batch gets that ingest time. A row never replaces one ingested later, so a batch
    may be applied twice. Both steps, choosing within the batch and replacing, share one shuffle.
    """
    if ingested_at is not None:
        batch = batch.withColumn("ingested_at", S.moment(ingested_at))
    both = live.select(*LIVE_COLUMNS, F.lit(0).alias("_new")).unionByName(
        batch.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    order = [F.desc("ingested_at"), F.desc("_new"), *newest_first]
    return latest_by_key(both, ["icao24"], order).select(*LIVE_COLUMNS)


def upsert_rows(current: DataFrame, batch: DataFrame, key: str, stamp: str) -> DataFrame:
    """Replace the rows of ``current`` by those of ``batch`` with the same key; the later stamp wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest_by_key(both, [key], [F.desc(stamp), F.desc("_new")]).drop("_new")


def retain(
    rows: DataFrame, column: str, as_of: Column | datetime, keep: timedelta, partition_hour: str | None = None
) -> DataFrame:
    """Drop what is older than ``keep`` before ``as_of``; the boundary itself stays.

    ``partition_hour`` names a folder column holding the truncated hour, so that whole folders are skipped.
    """
    bound = S.moment(as_of) - F.lit(keep)
    kept = rows.where(F.col(column) >= bound)
    if partition_hour:
        hour = rows.schema[partition_hour].dataType
        kept = kept.where(F.col(partition_hour) >= S.hour_of(bound).cast(hour))
    return kept


def purge_stale_live(live: DataFrame, as_of: Column | datetime, keep: timedelta = K.LIVE_RETENTION) -> DataFrame:
    return retain(live, "ingested_at", as_of, keep)


def purge_history(
    history: DataFrame,
    as_of: Column | datetime,
    keep: timedelta = K.HISTORY_RETENTION,
    partition_hour: str | None = None,
) -> DataFrame:
    return retain(history, "ingested_at", as_of, keep, partition_hour)


def purge_anomaly_hourly(
    anomalies: DataFrame, as_of: Column | datetime, keep: timedelta = K.ANOMALY_RETENTION
) -> DataFrame:
    return retain(anomalies, "hour_utc", as_of, keep)


def purge_runs(runs: DataFrame, as_of: Column | datetime, keep: timedelta = K.RUN_RETENTION) -> DataFrame:
    return retain(runs, "run_at", as_of, keep)


def airborne_only(rows: DataFrame) -> DataFrame:
    """The subset the history log keeps."""
    return rows.where(~F.col("on_ground"))


def history_rows(batch: DataFrame) -> DataFrame:
    """Airborne rows with the hour that names their folder."""
    hour = S.hour_of(F.col("ingested_at")).cast(batch.schema["ingested_at"].dataType)
    return airborne_only(batch).select(*LIVE_COLUMNS, hour.alias("ingest_hour"))


def append_history(batch: DataFrame, path: str) -> None:
    """Append to the log, one folder per hour (an action). A retry appends again; ``state.write_history`` does not.

    ``rebalance`` gives each hour its own files while splitting an hour that holds much of the batch.
    """
    rows = history_rows(batch).hint("rebalance", "ingest_hour")
    rows.write.mode("append").partitionBy("ingest_hour").parquet(path)


def run_row(
    accepted: DataFrame, as_of: Column | datetime, fetch_ms: int = 0, upsert_ms: int = 0, run_id: int | None = None
) -> DataFrame:
    """The run log row of a batch of accepted rows; an empty batch is an error."""
    counted = accepted.agg(F.count("*").cast("int").alias("n"))
    ok = F.col("n") > 0
    return counted.select(
        F.lit(run_id).cast("bigint").alias("id"),
        S.moment(as_of).alias("run_at"),
        F.col("n").alias("records_fetched"),
        F.col("n").alias("records_upserted"),
        F.lit(fetch_ms).cast("int").alias("fetch_ms"),
        F.when(ok, F.lit(upsert_ms)).otherwise(F.lit(0)).cast("int").alias("upsert_ms"),
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(~ok, K.EMPTY_FETCH_MESSAGE).alias("error_msg"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table, named ``<table>_rows``."""
    first = next(iter(tables.values()))
    counts = [table.agg(F.count("*")).scalar().alias(f"{name}_rows") for name, table in tables.items()]
    return first.sparkSession.range(1).select(*counts)
