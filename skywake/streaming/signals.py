"""Lost signals and hourly counts as a stateful stream over parsed vectors.

The state is the aircraft's latest vectors, keyed by hash buckets of addresses, and event time is the snapshot time. The watermark says
up to which snapshot nothing more can come; timers wake a bucket when it has passed the next snapshot that waits. A bucket then goes
through the snapshots in order, whatever order or batches they came in, so what it hands on depends on the snapshots alone.

- An aircraft in the air is lost at the first snapshot more than ``K.GHOST_RUN_GRACE`` behind its last vector, within
  ``K.GHOST_MAX_MINUTES``: one alert.
- At each snapshot, aircraft older than ``K.GHOST_AGE`` and low ones are counted, among those seen within ``K.LIVE_RETENTION``.

Every bucket is told of every snapshot with an accepted vector. Vectors that come behind the watermark are not looked at; Spark counts
them, see ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators import snapshots
from skywake.schemas import OBSERVED
from skywake.sources import files
from skywake.sources.tables import Store
from skywake.streaming.ingest import FUTURE

BUCKETS = 256
LATENESS = timedelta(minutes=15)
#: Parts in which the snapshots of a batch are told apart, so that none of them is one task's work.
SPREAD = 16

SEEN = ["icao24", "time", "callsign", "origin_country", "flying", "low", "landed", "file", "position"]
SIGNALS = "kind string, cycle bigint, icao24 string, callsign string, origin_country string, ghost_count bigint, low_alt_count bigint"
#: A bucket's vectors (columns of SEEN, as an Arrow stream), snapshots that wait, and the last one gone through.
STATE = "rows binary, waiting array<bigint>, last bigint"
HELD = pa.schema({
    "icao24": pa.string(), "time": pa.int64(), "callsign": pa.string(), "origin_country": pa.string(), "flying": pa.bool_(), "low": pa.bool_(),
    "landed": pa.int64(), "file": pa.int64(), "position": pa.int64(),
})
_NAMES = [field.split()[0] for field in SIGNALS.split(", ")]
_GRACE, _MOST = int(K.GHOST_RUN_GRACE.total_seconds()), K.GHOST_MAX_MINUTES * 60
_AGE, _KEEP = int(K.GHOST_AGE.total_seconds()), int(K.LIVE_RETENTION.total_seconds())


def bucketed(observed: DataFrame, buckets: int, lateness: timedelta) -> DataFrame:
    """The accepted vectors with their bucket, and each snapshot for every bucket; snapshots without any vector move the clock alone."""
    timed = (
        observed.where(F.col("reject_reason").isNull() | (F.col("reject_reason") != FUTURE))
        .withColumn("event_time", F.timestamp_seconds("cycle"))
        .withColumn("good", F.col("reject_reason").isNull())
        .withWatermark("event_time", f"{int(lateness.total_seconds())} seconds")
    )
    alone = F.lit(-1) - F.pmod(F.hash("file", "position"), F.lit(buckets))  # of no aircraft; a filter would keep them from the watermark, too
    rows = timed.select(
        F.when(F.col("good"), F.pmod(F.hash("icao24"), F.lit(buckets))).otherwise(alone).alias("bucket"), "event_time", "icao24", "time", "callsign",
        "origin_country", (~F.col("on_ground")).alias("flying"), S.is_low_altitude(F.col("on_ground"), F.col("geo_altitude")).alias("low"),
        F.unix_micros("landed").alias("landed"), "file", "position",
    )
    part = F.pmod(F.hash("file", "position"), F.lit(SPREAD)).alias("part")
    told = F.when(F.col("good"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(-1)))
    beats = timed.select("event_time", "good", part).dropDuplicates(["event_time", "good", "part"])
    # What a beat lacks is filled: a null would make floats of a task's numbers.
    filled = {"flying": F.lit(False), "low": F.lit(False), "landed": F.lit(0).cast("bigint"), "file": F.lit(0).cast("bigint"), "position": F.lit(0)}
    told_all = beats.select(F.explode(told).alias("bucket"), "event_time", F.unix_seconds("event_time").alias("time")).withColumns(filled)
    return rows.unionByName(told_all, allowMissingColumns=True)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(pa.Table.from_pandas(rows[SEEN], HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _held(state: GroupState) -> tuple[pd.DataFrame, list[int], int | None]:
    if not state.exists:
        return HELD.empty_table().to_pandas(), [], None
    rows, waiting, last = state.get
    return pa.ipc.open_stream(rows).read_pandas(), list(waiting), last


def _in_order(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by aircraft and time, that of the file landed last behind its equals, and whether the next one is of the same aircraft."""
    aircraft = pd.factorize(rows["icao24"])[0]
    order = np.lexsort([rows[name].to_numpy() for name in ("position", "file", "landed", "time")] + [aircraft])
    aircraft = aircraft[order]
    return rows.iloc[order], np.append(aircraft[1:] == aircraft[:-1], False)[: len(rows)]


def _added(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """At each of `size` snapshots, how many of the stretches [start, end) hold it."""
    real = start < end
    return np.cumsum(np.bincount(start[real], minlength=size + 1) - np.bincount(end[real], minlength=size + 1))[:size]


def _gone_through(ready: list[int], last: int | None, rows: pd.DataFrame, first: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket has to say of snapshots in order, and the rows it still needs; `last` is the snapshot before them, `first` a bucket that
    counts even nothing.

    A row is its aircraft's latest one from the first snapshot not before it to the one that shows the next row. Its age at each of these
    follows from their times, so it is looked at once, however many they are.
    """
    cycles, (rows, again) = np.array(ready, np.int64), _in_order(rows)
    time, flying, low = rows["time"].to_numpy(), rows["flying"].to_numpy(bool), rows["low"].to_numpy(bool)
    start = np.searchsorted(cycles, time)
    end = np.where(again, np.append(start[1:], 0)[: len(rows)], len(cycles))
    past = lambda age: np.searchsorted(cycles, time + age, side="right")  # noqa: E731  the first snapshot at which a row is older
    kept = np.minimum(end, past(_KEEP))
    ghosts = _added(len(cycles), np.maximum(start, past(_AGE))[flying], kept[flying])
    lows = _added(len(cycles), start[low], kept[low])
    lost = past(_GRACE)
    found = flying & (start <= lost) & (lost < end)
    found[found] &= cycles[lost[found]] - time[found] <= _MOST
    if last is not None:
        found &= (lost > 0) | (last - time <= _GRACE)  # no alert before
    alerts = rows.loc[found, ["icao24", "callsign", "origin_country"]].assign(kind="alert", cycle=cycles[lost[found]])
    told = (ghosts > 0) | (lows > 0) | first
    counts = pd.DataFrame({"kind": "count", "cycle": cycles[told], "ghost_count": ghosts[told], "low_alt_count": lows[told]})
    ahead = start == len(cycles)
    current = (start < end) & (cycles[-1] - time <= _KEEP)
    return pd.concat([alerts, counts]).reindex(columns=_NAMES), rows[ahead | current]


def run_bucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The signals of a bucket, as far as the watermark lets it see."""
    if key[0] < 0:  # clock alone
        return
    rows, waiting, last = _held(state)
    new = list(parts) if not state.hasTimedOut else []
    if new:
        waiting = sorted(set(waiting).union(*(part["time"].unique().tolist() for part in new)))
        rows = pd.concat([rows, *(part.loc[part["icao24"].notna(), SEEN] for part in new)], ignore_index=True)
        rows = rows.astype({"time": "int64", "landed": "int64", "file": "int64", "position": "int64", "flying": "bool", "low": "bool"})
    mark = state.getCurrentWatermarkMs()
    ready = [c for c in waiting if c * 1000 <= mark]
    if ready:
        out, rows = _gone_through(ready, last, rows, key[0] == 0)
        last, waiting = ready[-1], waiting[len(ready) :]
    if not len(rows) and not waiting:
        if state.exists:
            state.remove()
    else:
        state.update((_packed(rows), waiting, last))
        if waiting:
            state.setTimeoutTimestamp(waiting[0] * 1000 - 1)  # a timer rings when the watermark is past it
    if ready and len(out):
        yield out.astype({"ghost_count": "Int64", "low_alt_count": "Int64"})


def signals(observed: DataFrame, buckets: int = BUCKETS, lateness: timedelta = LATENESS) -> DataFrame:
    """Alerts and counts (see ``SIGNALS``) of a stream of ``OBSERVED`` rows."""
    return bucketed(observed, buckets, lateness).groupBy("bucket").applyInPandasWithState(run_bucket, SIGNALS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_signals(
    spark: SparkSession,
    store: Store,
    checkpoint: str,
    max_files: int | None = None,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
    lateness: timedelta = LATENESS,
) -> StreamingQuery:
    """Follow the log of observations that ``ingest.start_ingest`` writes; by default once over what is there.

    The result is appended to the store by Spark's file sink, each batch once.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.readStream.schema(OBSERVED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    found = signals(reader.parquet(store.observed.path), buckets, lateness)
    writer = found.writeStream.format("parquet").outputMode("append").option("path", store.signals).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, in the progress that Spark has kept of a query."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators if s.operatorName == "applyInPandasWithState")


def _stored(store: Store, kind: str) -> DataFrame:
    known = files.exists(store.spark, store.signals)
    rows = store.spark.read.schema(SIGNALS).parquet(store.signals) if known else store.spark.createDataFrame([], SIGNALS)
    return rows.where(F.col("kind") == kind).withColumn("cycle", F.timestamp_seconds("cycle").cast("timestamp_ntz"))


def alerts(store: Store) -> DataFrame:
    """cycle, icao24 and message of all lost signals so far."""
    text = S.feed_message(F.lit("ghost"), F.col("callsign"), F.col("icao24"), F.col("origin_country"), F.lit(None).cast("double"))
    return _stored(store, "alert").select("cycle", "icao24", text.alias("message"))


def hourly(store: Store) -> DataFrame:
    """For each hour within retention the counts of its last snapshot so far."""
    counts = _stored(store, "count").groupBy("cycle").agg(*(F.sum(c).cast("int").alias(c) for c in ("ghost_count", "low_alt_count")))
    rows = counts.select(S.hour_of(F.col("cycle")).alias("hour_utc"), "ghost_count", "low_alt_count", F.col("cycle").alias("updated_at"))
    last = snapshots.latest_by_key(rows, ["hour_utc"], [F.desc("updated_at")])
    return snapshots.purge_anomaly_hourly(last, last.agg(F.max("updated_at")).scalar())
