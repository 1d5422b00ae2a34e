"""Filters and projections of the live table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from skywake import constants as K
from skywake.functions import geo, scalars as S
from skywake.schemas import LIVE_COLUMNS


def positioned(live: DataFrame) -> DataFrame:
    """Rows with a position, those on the ground included."""
    return live.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def airborne_positioned(live: DataFrame) -> DataFrame:
    return live.where(S.is_airborne_positioned())


def scan_live_positions(live: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows with a position; a client that takes fewer gets the first by address."""
    rows = positioned(live).select(*LIVE_COLUMNS)
    return rows if limit is None else rows.orderBy("icao24").limit(limit)


def bbox_filter(live: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return live.where(geo.in_box(F.col("lat"), F.col("lon"), south, west, north, east))


def convert_units(live: DataFrame) -> DataFrame:
    return live.select(
        "icao24",
        S.feet(F.col("geo_altitude")).alias("altitude_ft"),
        S.knots(F.col("velocity")).alias("speed_kt"),
    )


def flight_cards(flights: DataFrame, ghosts: DataFrame) -> DataFrame:
    """Display fields of every aircraft, with the status by membership among the ghosts."""
    lost = ghosts.select("icao24", F.lit(True).alias("lost")).distinct()
    none = F.lit(K.NO_VALUE)
    speed = F.concat(S.half_up(S.knots(F.col("velocity"))).cast("string"), F.lit(" kts"))
    heading = F.concat(S.half_up(F.col("true_track")).cast("string"), F.lit("°"))
    return flights.join(lost, "icao24", "left").select(
        S.display_id(F.col("callsign"), F.col("icao24")).alias("title"),
        "icao24",
        F.coalesce("origin_country", none).alias("country"),
        F.coalesce(S.altitude_text(F.col("geo_altitude")), none).alias("altitude"),
        F.when(S.filled_number(F.col("velocity")), speed).otherwise(none).alias("speed"),
        F.coalesce(heading, none).alias("heading"),
        F.when(F.col("lost"), "SIGNAL LOST").otherwise("LIVE").alias("status"),
    )


def ghost_flag(flights: DataFrame, ghosts: DataFrame) -> DataFrame:
    """The rows with ``is_ghost`` by membership."""
    lost = ghosts.select("icao24", F.lit(True).alias("is_ghost")).distinct()
    return flights.join(lost, "icao24", "left").withColumn("is_ghost", F.coalesce("is_ghost", F.lit(False)))


def non_ghost_flights(flights: DataFrame, ghosts: DataFrame) -> DataFrame:
    return flights.join(ghosts.select("icao24"), "icao24", "left_anti")


def performance_scatter(
    live: DataFrame, wide: bool = False, speed_below: int = 700, limit: int | None = None
) -> DataFrame:
    """Speed against altitude of moving airborne aircraft, all of them; a chart that takes fewer gets the first by address.

    The wide form needs a position, has five bands and no upper altitude; the other has three bands and
    stops below 55,000 ft.
    """
    velocity, geo_altitude = F.col("velocity"), F.col("geo_altitude")
    base = airborne_positioned(live) if wide else live.where(~F.col("on_ground"))
    band = S.performance_band5(geo_altitude) if wide else S.performance_band3(geo_altitude)
    rows = base.where(S.filled_number(velocity) & S.filled_number(geo_altitude)).select(
        "icao24",
        "callsign",
        "origin_country",
        S.half_up(S.knots(velocity)).alias("speed"),
        S.half_up(S.feet(geo_altitude)).alias("altitude"),
        band.alias("band"),
    )
    shown = (F.col("speed") > 0) & (F.col("speed") < speed_below) & (F.col("altitude") > 0)
    if not wide:
        shown = shown & (F.col("altitude") < 55000)
    points = rows.where(shown)
    return points if limit is None else points.orderBy("icao24").limit(limit)


def altitude_profile(history: DataFrame, order: list[str], icao24: str | None = None, limit: int = 60) -> DataFrame:
    """The first points of the altitude curve of one aircraft, or of every aircraft at once.

    For all aircraft a limit up to 1,000 is applied in each map task before the shuffle.
    """
    geo_altitude, baro_altitude = F.col("geo_altitude"), F.col("baro_altitude")
    shown = [
        "icao24",
        F.col("point"),
        S.hour_label(F.col("ingested_at")).alias("time"),
        F.when(S.filled_number(geo_altitude), S.half_up(S.feet(geo_altitude)))
        .when(S.filled_number(baro_altitude), S.half_up(S.feet(baro_altitude)))
        .otherwise(F.lit(0))
        .alias("alt"),
    ]
    rows = history if icao24 is None else history.where(F.col("icao24") == icao24)
    window = W.partitionBy("icao24").orderBy(*order)
    return rows.withColumn("point", F.row_number().over(window)).where(F.col("point") <= limit).select(*shown)
