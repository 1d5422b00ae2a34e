"""Counts by airline, altitude band and country, and what the charts derive from them.

``by`` repeats an aggregate for each value of further columns, such as a cycle or an hour of the history
log. Every aggregate is combined in the map tasks, so a hot group costs one row per task. What follows the
aggregate runs on at most a few dozen rows per value of ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators.ghosts import is_ghost
from skywake.operators.positions import airborne_positioned
from skywake.operators.ranking import groups_of, join_counts, top_rows


def _airline_order() -> list[Column]:
    return [F.desc("flight_count"), F.asc("airline")]


def airline_counts(live: DataFrame, by: Sequence[str] = (), longest_prefix: bool = False) -> DataFrame:
    flying = live.where(F.col("callsign").isNotNull() & ~F.col("on_ground"))
    airline = S.airline_name(F.col("callsign"), longest_prefix).alias("airline")
    return flying.groupBy(*by, airline).agg(F.count("*").alias("flight_count"))


def airline_activity(live: DataFrame, by: Sequence[str] = (), longest_prefix: bool = False) -> DataFrame:
    """Airborne flights with a callsign by airline, most first."""
    return airline_counts(live, by, longest_prefix).orderBy(*by, *_airline_order())


def altitude_distribution(live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    band = S.altitude_band(F.col("on_ground"), F.col("geo_altitude")).alias("band")
    return live.groupBy(*by, band).agg(F.count("*").alias("flight_count"))


def country_activity(live: DataFrame, by: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """Airborne flights by country, the first 20."""
    flying = live.where(~F.col("on_ground") & F.col("origin_country").isNotNull())
    counts = flying.groupBy(*by, "origin_country").agg(F.count("*").alias("flights_now"))
    return top_rows(counts, [F.desc("flights_now"), F.asc("origin_country")], limit, by)


def dashboard_stats(
    live: DataFrame, as_of: Column | datetime, runs: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Headline numbers in one pass; the countries are counted over all rows, those on the ground included."""
    stats = live.groupBy(*by).agg(
        F.count_if(~F.col("on_ground")).alias("flights_in_air"),
        F.count_if(F.col("on_ground")).alias("flights_on_ground"),
        F.countDistinct("origin_country").alias("countries_active"),
        F.count_if(is_ghost(runs, as_of)).alias("ghost_count"),
        F.max("ingested_at").alias("last_ingested_at"),
    )
    seconds = F.round(S.seconds_between(F.col("last_ingested_at"), S.moment(as_of))).cast("int")
    return stats.withColumn("seconds_since_sync", seconds)


def band_spine(bands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The five bands in display order, missing ones with zero."""
    spine = groups_of(bands, by).select(
        *by, F.posexplode(F.array(*[F.lit(name) for name in K.BAND_ORDER])).alias("ord", "band")
    )
    return join_counts(spine, bands, [*by, "band"], bool(by)).select(
        *by, "ord", "band", F.coalesce("flight_count", F.lit(0)).alias("flight_count")
    )


def band_shares(bands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each band, and where its slice starts and ends in display order (five rows)."""
    everything = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    in_order = W.partitionBy(*by).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = band_spine(bands, by).select(
        "*", F.sum("flight_count").over(everything).alias("n"), F.sum("flight_count").over(in_order).alias("upto")
    )
    total = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("n"))
    return counted.select(
        *by,
        "ord",
        "band",
        "flight_count",
        (F.col("flight_count") / total).alias("fraction"),
        S.percent_of(F.col("flight_count"), total).alias("percent"),
        ((F.col("upto") - F.col("flight_count")) / total).alias("slice_start"),
        (F.col("upto") / total).alias("slice_end"),
    )


def country_share(countries: DataFrame, limit: int = 6, total: Column | None = None) -> DataFrame:
    """Rank and share of the first countries of the list (at most 20 rows).

    The share refers to the list, unless ``total`` gives another denominator.
    """
    order = W.orderBy(F.desc("flights_now"), F.asc("origin_country"))
    listed = F.sum("flights_now").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = countries.select("*", F.row_number().over(order).alias("rank"), listed.alias("listed"))
    whole = total if total is not None else F.col("listed")
    share = F.col("flights_now") / F.when(whole == 0, F.lit(1)).otherwise(whole) * F.lit(100)
    return ranked.where(F.col("rank") <= limit).select(
        "rank", "origin_country", "flights_now", S.to_fixed(share, 1).alias("share_pct")
    )


def airline_bars(live: DataFrame, bars: int = 7, race: int = 5, listed_rows: int = 10) -> DataFrame:
    """The first airlines with their width relative to the first, all kinds included (at most ``listed_rows``)."""
    listed = airline_counts(live).orderBy(*_airline_order()).limit(listed_rows)
    order = W.orderBy(*_airline_order())
    ranked = listed.select(
        F.row_number().over(order).cast("int").alias("rank"),
        "airline",
        "flight_count",
        S.percent_of(F.col("flight_count"), F.first("flight_count").over(order)).alias("width_pct"),
    )
    return ranked.where(F.col("rank") <= bars).withColumn("in_race", F.col("rank") <= race)


def airline_race(live: DataFrame, listed_rows: int = 10) -> DataFrame:
    """Rank of the named airlines among the first rows, where ``Other`` takes a place and then drops out."""
    listed = airline_counts(live).orderBy(*_airline_order()).limit(listed_rows)
    order = W.orderBy(*_airline_order())
    return listed.where(F.col("airline") != K.OTHER_AIRLINE).select(
        F.row_number().over(order).cast("int").alias("rank"),
        "airline",
        "flight_count",
        S.percent_of(F.col("flight_count"), F.first("flight_count").over(order)).alias("width_pct"),
    )


def tracked_flights(live: DataFrame, listed_rows: int = 10) -> DataFrame:
    """One row: flights of the first airline rows."""
    listed = airline_counts(live).orderBy(*_airline_order()).limit(listed_rows)
    return listed.agg(F.coalesce(F.sum("flight_count"), F.lit(0)).alias("tracked_flights"))


def country_speed(live: DataFrame, by: Sequence[str] = (), at_least: int = 3, limit: int = 15) -> DataFrame:
    """Average speed by country with its share of the fastest and the difference to a typical cruise."""
    moving = airborne_positioned(live).where(
        S.filled_number(F.col("velocity")) & S.filled_text(F.col("origin_country"))
    )
    averages = (
        moving.groupBy(*by, "origin_country")
        .agg(S.half_up(F.avg(S.knots(F.col("velocity")))).alias("avg_kt"), F.count("*").alias("n"))
        .where(F.col("n") >= at_least)
    )
    order = [F.desc("avg_kt"), F.asc("origin_country")]
    listed = top_rows(averages, order, limit, by)
    ranking = W.partitionBy(*by).orderBy(*order)
    fastest = F.first("avg_kt").over(ranking)
    leader = F.when(fastest == 0, F.lit(1)).otherwise(fastest)
    return listed.select(
        *by,
        F.row_number().over(ranking).cast("int").alias("rank"),
        "origin_country",
        "avg_kt",
        "n",
        S.percent_of(F.col("avg_kt"), leader).alias("width_pct"),
        (F.col("avg_kt") - F.lit(K.TYPICAL_CRUISE_KNOTS)).alias("diff_kt"),
    )
