"""The run log: recent runs, health metrics and hourly congestion."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake.functions import scalars as S


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_at"), F.desc("id")).limit(limit)


def run_metrics(runs: DataFrame, over: int = 10) -> DataFrame:
    """One row of health figures over the latest runs; a missing time counts as zero."""
    ok = F.col("status") == "success"
    newest = F.struct("run_at", "id")
    figures = recent_runs(runs, over).agg(
        S.half_up(F.avg(F.when(ok, F.coalesce("fetch_ms", F.lit(0))))).alias("avg_fetch_ms"),
        S.half_up(F.avg(F.when(ok, F.coalesce("upsert_ms", F.lit(0))))).alias("avg_upsert_ms"),
        F.max_by(F.struct("records_upserted", "run_at", "status"), newest).alias("last"),
        F.count_if(ok).alias("n_ok"),
        F.count("*").alias("n"),
    )
    return figures.select(
        "avg_fetch_ms",
        "avg_upsert_ms",
        F.col("last.records_upserted").alias("total_records"),
        F.col("last.run_at").alias("last_run_at"),
        F.col("last.status").alias("last_status"),
        F.when(F.col("n") > 0, S.percent_of(F.col("n_ok"), F.col("n"))).alias("success_rate"),
    )


def scan_runs_today(runs: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Upserted counts of the successful runs since midnight UTC."""
    midnight = S.day_of(S.moment(as_of)).cast(runs.schema["run_at"].dataType)
    return runs.where((F.col("run_at") >= midnight) & (F.col("status") == "success")).select("records_upserted")


def records_today(runs: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row: the sum of those counts, null where it is zero."""
    total = F.coalesce(F.sum("records_upserted"), F.lit(0))
    return scan_runs_today(runs, as_of).agg(F.nullif(total, F.lit(0)).alias("records_today"))


def hour_spine(rows: DataFrame, ts: str, as_of: Column | datetime, hours: int = 24) -> DataFrame:
    """The hours up to the present one, as ``hs`` of the type of column ``ts``."""
    now = S.moment(as_of)
    start = S.hour_of(now - F.lit(timedelta(hours=hours - 1)))
    steps = F.sequence(start, S.hour_of(now), F.lit(timedelta(hours=1)))
    spine = rows.sparkSession.range(1).select(F.explode(steps).alias("hs"))
    return spine.select(F.col("hs").cast(rows.schema[ts].dataType).alias("hs"))


def hourly_average(runs: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Average upserted count of the successful runs of each hour within the last 24 hours."""
    recent = (F.col("run_at") >= S.moment(as_of) - F.lit(timedelta(hours=24))) & (F.col("status") == "success")
    hour = S.hour_of(F.col("run_at")).cast(runs.schema["run_at"].dataType)
    average = F.round(F.avg("records_upserted")).cast("bigint")
    return runs.where(recent).groupBy(hour.alias("hs")).agg(average.alias("cnt"))


def congestion_hours(runs: DataFrame, as_of: Column | datetime) -> DataFrame:
    """24 rows ``hs, hour, count``, gaps with zero. The averages have at most 25 rows."""
    averages = F.broadcast(hourly_average(runs, as_of))
    return hour_spine(runs, "run_at", as_of).join(averages, "hs", "left").select(
        "hs", S.hour_label(F.col("hs")).alias("hour"), F.coalesce("cnt", F.lit(0)).alias("count")
    )


def hourly_congestion(runs: DataFrame, as_of: Column | datetime) -> DataFrame:
    """The public form of ``congestion_hours``, in order."""
    return congestion_hours(runs, as_of).orderBy("hs").select("hour", "count")


def congestion_total(congestion: DataFrame) -> DataFrame:
    return congestion.agg(F.sum("count").alias("total"))


def congestion_peak(congestion: DataFrame) -> DataFrame:
    """The busiest hour, the earlier one of equals; no row if all are zero."""
    return congestion.where(F.col("count") > 0).orderBy(F.desc("count"), "hs").limit(1).select("hour", "count")


def _hour_of(label: str = "hour") -> Column:
    return F.substring(label, 1, 2).cast("int")


def morning_night_peaks(congestion: DataFrame) -> DataFrame:
    """The busiest hour of the morning (4 to 11) and of the night (18 to 3); none for a period of zeros."""
    h = _hour_of()
    period = F.when(h.between(4, 11), "morning").when((h >= 18) | (h <= 3), "night")
    first = F.row_number().over(W.partitionBy("period").orderBy(F.desc("count"), F.asc("hs")))
    ranked = congestion.withColumn("period", period).where(F.col("period").isNotNull() & (F.col("count") > 0))
    return ranked.withColumn("place", first).where("place = 1").select("period", "hour", "count")


def congestion_bars(congestion: DataFrame) -> DataFrame:
    """Bar height, daylight and peak marks of the 24 hours."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    highest = F.greatest(F.max("count").over(everything), F.lit(1))
    h = _hour_of()
    peaks = F.broadcast(morning_night_peaks(congestion).select("hour", F.lit(True).alias("is_peak")))
    return congestion.withColumn(
        "height_pct", F.greatest(F.lit(4), S.percent_of(F.col("count"), highest))
    ).join(peaks, "hour", "left").select(
        "hour",
        "count",
        "height_pct",
        ((h >= 6) & (h < 20)).alias("is_day"),
        F.coalesce("is_peak", F.lit(False)).alias("is_peak"),
    )


def activity_clock(congestion: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Intensity of each hour, with marks for the present hour and for every peak."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    highest = F.greatest(F.max("count").over(everything), F.lit(1))
    now = S.hour_label(S.hour_of(S.moment(as_of)))
    return congestion.select(
        "hour",
        "count",
        (F.col("count") / highest).alias("intensity"),
        (F.col("hour") == now).alias("is_now"),
        (F.col("count") == highest).alias("is_peak"),
    )
