"""Hourly anomaly counts and the history log by hour."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators.ghosts import is_ghost
from skywake.operators.snapshots import airborne_only, upsert_rows


def anomaly_hour_rollup(live: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row: the present hour with its ghosts (age rule) and low flights, in one pass over the live table."""
    now = S.moment(as_of)
    hour = S.hour_of(now).cast(live.schema["ingested_at"].dataType)
    counts = live.agg(
        F.count_if(is_ghost(as_of=now)).cast("int").alias("ghost_count"),
        F.count_if(S.is_low_altitude(F.col("on_ground"), F.col("geo_altitude"))).cast("int").alias("low_alt_count"),
    )
    return counts.select(hour.alias("hour_utc"), "ghost_count", "low_alt_count", now.alias("updated_at"))


def upsert_anomaly_hour(anomalies: DataFrame, rollup: DataFrame) -> DataFrame:
    """Replace the row of the hour; counts are overwritten, not added."""
    return upsert_rows(anomalies, rollup, "hour_utc", "updated_at")


def scan_anomaly_window(anomalies: DataFrame, as_of: Column | datetime) -> DataFrame:
    """The last 24 hours, in order."""
    since = S.moment(as_of) - F.lit(timedelta(hours=24))
    return (
        anomalies.where(F.col("hour_utc") >= since)
        .select("hour_utc", "ghost_count", "low_alt_count")
        .orderBy("hour_utc")
    )


def anomaly_timeline(window: DataFrame) -> DataFrame:
    """24 hours of the day, gaps with zero; of two rows for one hour of the day the later counts.

    The grouped side has at most 24 rows.
    """
    zero = F.lit(0)
    latest = window.groupBy(F.hour("hour_utc").alias("h")).agg(
        F.max_by("ghost_count", "hour_utc").alias("g"), F.max_by("low_alt_count", "hour_utc").alias("l")
    )
    day = window.sparkSession.range(24).select(F.col("id").cast("int").alias("h"))
    filled = day.join(F.broadcast(latest), "h", "left").select(
        F.format_string("%02d:00", "h").alias("hour"),
        F.coalesce("g", zero).alias("ghost"),
        F.coalesce("l", zero).alias("low_alt"),
    )
    return filled.withColumn("total", F.col("ghost") + F.col("low_alt"))


def anomaly_peak(timeline: DataFrame) -> DataFrame:
    """The hour with most alerts, the earlier one of equals; no row if all are zero."""
    return timeline.where(F.col("total") > 0).orderBy(F.desc("total"), "hour").limit(1)


def alert_distribution(window: DataFrame) -> DataFrame:
    """One row: totals of the window and their percentages; the remainder counts as deviations."""
    sums = window.agg(
        F.coalesce(F.sum("ghost_count"), F.lit(0)).alias("total_ghost"),
        F.coalesce(F.sum("low_alt_count"), F.lit(0)).alias("total_low_alt"),
    )
    whole = F.greatest(F.col("total_ghost") + F.col("total_low_alt"), F.lit(1))
    parts = sums.select(
        "*",
        S.percent_of(F.col("total_ghost"), whole).alias("ghost_pct"),
        S.percent_of(F.col("total_low_alt"), whole).alias("low_alt_pct"),
    )
    rest = F.lit(100) - F.col("ghost_pct") - F.col("low_alt_pct")
    return parts.withColumn("deviation_pct", F.greatest(F.lit(0), rest))


def history_hourly(history: DataFrame) -> DataFrame:
    """Distinct airborne aircraft per hour of the log.

    The distinct count first groups by hour and address, so one crowded hour is spread over all tasks.
    """
    hour = S.hour_of(F.col("ingested_at")).cast(history.schema["ingested_at"].dataType)
    flying = airborne_only(history)
    return flying.groupBy(hour.alias("hs")).agg(F.countDistinct("icao24").alias("aircraft"))


#: Logarithm of the number of registers of a sketch; its standard error is 1.04 / sqrt(2^14), below 1 percent.
SKETCH_POWER = 14
#: What an estimate is off by at most, as a share of the exact count: four standard errors.
SKETCH_ERROR = 0.033


def hourly_sketches(history: DataFrame) -> DataFrame:
    """hs and a sketch of the airborne aircraft of each hour in ``history``; sketches of parts can be merged."""
    hour = S.hour_of(F.col("ingested_at")).cast(history.schema["ingested_at"].dataType)
    return airborne_only(history).groupBy(hour.alias("hs")).agg(F.hll_sketch_agg("icao24", SKETCH_POWER).alias("sketch"))


def merged_hourly(sketches: DataFrame, hours: int = 1) -> DataFrame:
    """hs and aircraft, the estimated number in each hour (or each stretch of so many ``hours``), from sketches of any parts of the log."""
    seconds = F.unix_seconds(F.col("hs").cast("timestamp"))
    start = F.timestamp_seconds(F.floor(seconds / (3600 * hours)) * 3600 * hours).cast(sketches.schema["hs"].dataType)
    return sketches.groupBy(start.alias("hs")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("aircraft"))


def stream_history_hourly(
    history: DataFrame, late: timedelta = K.CYCLE_INTERVAL, relative_error: float = 0.01
) -> DataFrame:
    """The same over a stream, with an approximate count whose state per hour is fixed in size.

    Event time must be a zoned timestamp; the hours come back in the type of the log.
    """
    stored = history.schema["ingested_at"].dataType
    zoned = airborne_only(history).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    counts = (
        zoned.withWatermark("ingested_at", f"{int(late.total_seconds())} seconds")
        .groupBy(F.window("ingested_at", "1 hour"))
        .agg(F.approx_count_distinct("icao24", relative_error).alias("aircraft"))
    )
    return counts.select(F.col("window.start").cast(stored).alias("hs"), "aircraft")
