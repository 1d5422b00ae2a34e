"""Aircraft whose signal was lost, and the live feed of events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators.positions import positioned
from skywake.operators.ranking import top_per


def last_success_threshold(runs: DataFrame, grace: timedelta = K.GHOST_RUN_GRACE) -> DataFrame:
    """One row: the last successful run minus the grace; null without one, so that nothing is a ghost."""
    last = runs.where(F.col("status") == "success").agg(F.max("run_at").alias("last_run"))
    return last.select((F.col("last_run") - F.lit(grace)).alias("threshold"))


def is_ghost(runs: DataFrame | None = None, as_of: Column | datetime | None = None) -> Column:
    """Airborne and unseen since the last successful run, or without ``runs`` for two minutes.

    The threshold is a scalar subquery: computed once, then compared in the scan.
    """
    bound = last_success_threshold(runs).scalar() if runs is not None else S.moment(as_of) - F.lit(K.GHOST_AGE)
    return ~F.col("on_ground") & (F.col("ingested_at") < bound)


def ghosts_of(live: DataFrame, as_of: Column | datetime, runs: DataFrame | None = None) -> DataFrame:
    """The ghost rows, unordered; by the run rule with ``runs``, else by the age rule."""
    kept = [c for c in live.columns if c == "cycle"]
    return live.where(is_ghost(runs, as_of)).select(
        *kept,
        "icao24",
        "callsign",
        "origin_country",
        "lat",
        "lon",
        F.round(S.feet(F.col("geo_altitude")), 0).alias("altitude_ft"),
        "true_track",
        "ingested_at",
        S.minutes_between(F.col("ingested_at"), S.moment(as_of)).alias("minutes_since_contact"),
    )


def ghost_flights(live: DataFrame, as_of: Column | datetime, runs: DataFrame | None = None) -> DataFrame:
    """The ghost rows, oldest first."""
    return ghosts_of(live, as_of, runs).orderBy("ingested_at", "icao24")


def scan_recent_ghosts(
    live: DataFrame,
    as_of: Column | datetime,
    runs: DataFrame | None = None,
    max_minutes: float = K.GHOST_MAX_MINUTES,
) -> DataFrame:
    """Ghosts lost within the last quarter of an hour."""
    return ghosts_of(live, as_of, runs).where(F.col("minutes_since_contact") <= max_minutes)


def ghost_alerts(ghosts: DataFrame, limit: int = 6) -> DataFrame:
    """The alerts beside the map: the ghosts lost longest."""
    return ghosts.orderBy("ingested_at", "icao24").limit(limit)


def ghost_table_rows(ghosts: DataFrame) -> DataFrame:
    """Display fields of the ghost table. Positions are always written as N and E."""
    none = F.lit(K.NO_VALUE)
    lat = F.coalesce(F.concat(S.to_fixed(F.col("lat"), 4), F.lit("° N")), none)
    lon = F.coalesce(F.concat(S.to_fixed(F.col("lon"), 4), F.lit("° E")), none)
    ago = F.concat(S.half_up(F.col("minutes_since_contact")).cast("string"), F.lit("m ago"))
    altitude = S.grouped_digits(F.col("altitude_ft").cast("bigint"))
    return ghosts.select(
        S.display_id(F.col("callsign"), F.col("icao24")).alias("id"),
        "icao24",
        F.coalesce("origin_country", none).alias("country"),
        F.concat(lat, F.lit(", "), lon).alias("position"),
        F.coalesce(ago, none).alias("last_contact"),
        F.when(S.filled_number(F.col("altitude_ft")), altitude).otherwise(none).alias("altitude"),
    )


def snapshot_health(live: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row: seconds since the last ingest and whether ingestion itself is down."""
    last = live.agg(F.max("ingested_at").alias("last_ingested_at"))
    seconds = F.round(S.seconds_between(F.col("last_ingested_at"), S.moment(as_of))).cast("int")
    return last.select(seconds.alias("seconds_since_sync")).withColumn(
        "pipeline_down", F.coalesce("seconds_since_sync", F.lit(0)) > K.OUTAGE_SECONDS
    )


def enrich_ghosts(ghosts: DataFrame, live: DataFrame, health: DataFrame) -> DataFrame:
    """Ghosts with the remaining fields of their live row; none at all while ingestion is down.

    Both sides are keyed by address, so the join reuses the partitioning of the snapshot.
    """
    extra = positioned(live).select(
        "icao24", "baro_altitude", "geo_altitude", "on_ground", "velocity", "vertical_rate"
    )
    up = ~health.select("pipeline_down").scalar()
    return ghosts.where(S.filled_text(F.col("icao24")) & up).join(extra, "icao24", "left")


def new_ghosts(ghosts: DataFrame, previous: DataFrame) -> DataFrame:
    """Ghosts that were none in the previous cycle."""
    return ghosts.join(previous.select("icao24"), "icao24", "left_anti")


def cycle_marks(snapshots: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """number, success (the last successful run up to it) and down of each ``cycle`` of ``snapshots``: a row per cycle.

    The windows run over the cycles and, with ``runs``, the run log.
    """
    last = snapshots.groupBy("cycle").agg(F.max("ingested_at").alias("last"))
    down = S.seconds_between(F.col("last"), F.col("cycle")) > K.OUTAGE_SECONDS
    marks = last.select("cycle", down.alias("down"), F.lit(None).cast(snapshots.schema["cycle"].dataType).alias("success"))
    if runs is not None:
        good = runs.where(F.col("status") == "success").select(F.col("run_at").alias("cycle"), F.lit(None).cast("boolean").alias("down"), F.col("run_at").alias("success"))
        upto = W.orderBy("cycle").rangeBetween(W.unboundedPreceding, W.currentRow)
        marks = marks.unionByName(good).withColumn("success", F.max("success").over(upto)).where(F.col("down").isNotNull())
    return marks.withColumn("number", F.row_number().over(W.orderBy("cycle")))


def live_feed(
    snapshots: DataFrame,
    runs: DataFrame | None = None,
    size: int = K.FEED_SIZE,
    cruise_picks: int = K.FEED_CRUISE_PICKS,
) -> DataFrame:
    """The latest events over snapshots with a ``cycle`` column, newest cycle first.

    A cycle gives the ghosts that were none in the cycle before it, however long ago that was: by the last successful run
    with ``runs``, else by the age rule, and none while ingestion is down. Then two aircraft above 9,000 m that are no
    ghosts, picked by a digest of address and cycle, so that the pick can be repeated.
    """
    cycle = F.col("cycle")
    marked = snapshots.join(cycle_marks(snapshots, runs), "cycle")
    bound = cycle - F.lit(K.GHOST_AGE) if runs is None else F.col("success") - F.lit(K.GHOST_RUN_GRACE)
    recent = S.minutes_between(F.col("ingested_at"), cycle) <= K.GHOST_MAX_MINUTES
    ghosts = marked.where(~F.col("down") & ~F.col("on_ground") & (F.col("ingested_at") < bound) & recent)
    before = ghosts.select("icao24", (F.col("number") + 1).alias("number"))
    lost = ghosts.join(before, ["icao24", "number"], "left_anti").select(
        "cycle",
        F.lit("ghost").alias("kind"),
        "icao24",
        "callsign",
        "origin_country",
        F.lit(None).cast("double").alias("geo_altitude"),
        "ingested_at",
        F.lit("").alias("pick"),
    )
    digest = F.md5(F.concat("icao24", F.unix_micros(cycle.cast("timestamp")).cast("string")))
    high = (
        positioned(snapshots)
        .where(F.col("geo_altitude") > K.CRUISE_EVENT_METERS)
        .join(ghosts.select("icao24", "cycle"), ["icao24", "cycle"], "left_anti")
        .withColumn("pick", digest)
    )
    cruising = top_per(high, ["cycle"], [F.col("pick"), F.col("icao24")], cruise_picks).select(
        "cycle",
        F.lit("cruise").alias("kind"),
        "icao24",
        "callsign",
        "origin_country",
        "geo_altitude",
        "ingested_at",
        "pick",
    )
    newest = [F.desc("cycle"), F.desc("kind"), F.when(F.col("kind") == "ghost", F.col("ingested_at"))]
    feed = lost.unionByName(cruising).orderBy(*newest, "pick", "icao24").limit(size)
    return feed.select(
        "cycle",
        "kind",
        "icao24",
        S.feed_message(
            F.col("kind"), F.col("callsign"), F.col("icao24"), F.col("origin_country"), F.col("geo_altitude")
        ).alias("message"),
    )
