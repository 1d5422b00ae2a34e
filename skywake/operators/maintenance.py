"""Views kept up to date from what an upsert changes, not from the whole live table.

A live row is counted under what the views group by (airline, altitude band, country, ..) and under its ingest time. An upsert that replaces
a row takes one from the counts of the old row and adds one to those of the new row, so only changed rows are read. Rows leave the
live table by age; as the counts know the ingest time, the rows that have left are simply not added up. A country is active
as long as a row that is counted refers to it, which makes the distinct count exact. The counts have a row for each
key and ingest time within retention, however many aircraft there are.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators.ranking import top_rows
from skywake.operators.snapshots import retain

AIRLINE, BAND, COUNTRY, FLYING_COUNTRY, PLACE = "airline", "band", "country", "flying_country", "place"
AIR, GROUND = "air", "ground"


def _entries(row: Column) -> Column:
    """view and key of everything that a live row counts under."""
    at = row.getField
    flying = ~at("on_ground")
    entry = lambda view, key: F.struct(F.lit(view).alias("view"), key.alias("key"))
    return F.array_compact(
        F.array(
            entry(BAND, S.altitude_band(at("on_ground"), at("geo_altitude"))),
            F.when(flying & at("callsign").isNotNull(), entry(AIRLINE, S.airline_name(at("callsign")))),
            F.when(at("origin_country").isNotNull(), entry(COUNTRY, at("origin_country"))),
            F.when(flying & at("origin_country").isNotNull(), entry(FLYING_COUNTRY, at("origin_country"))),
            F.when(at("on_ground").isNotNull(), entry(PLACE, F.when(flying, AIR).otherwise(GROUND))),
        )
    )


def deltas(changes: DataFrame) -> DataFrame:
    """view, key, ingested_at and n (what to add) of changed rows ``old`` and ``new``; a missing one is null."""
    sides = F.array_compact(
        F.array(*(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("row"), F.lit(n).cast("bigint").alias("n"))) for name, n in (("old", -1), ("new", 1))))
    )
    replaced = F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new")) | (F.to_json("old") != F.to_json("new"))
    each = changes.where(replaced).select(F.explode(sides).alias("side")).select("side.row", "side.n")
    listed = each.select("n", F.col("row.ingested_at").alias("ingested_at"), F.explode(_entries(F.col("row"))).alias("entry"))
    return _summed(listed.select("entry.view", "entry.key", "ingested_at", "n"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("view", "key", "ingested_at").agg(F.sum("n").alias("n")).where("n <> 0")


def applied(counts: DataFrame, changes: DataFrame, as_of: Column | datetime) -> DataFrame:
    """``counts`` after ``changes`` (see ``deltas``), without ingest times past retention."""
    return retain(_summed(counts.unionByName(deltas(changes))), "ingested_at", as_of, K.LIVE_RETENTION)


def _of(counts: DataFrame, view: str, as_of: Column | datetime, key: str, n: str) -> DataFrame:
    held = retain(counts.where(F.col("view") == view), "ingested_at", as_of, K.LIVE_RETENTION)
    return held.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias(n)).where(F.col(n) > 0)


def airline_activity(counts: DataFrame, as_of: Column | datetime) -> DataFrame:
    """``activity.airline_activity`` from the counts."""
    return _of(counts, AIRLINE, as_of, "airline", "flight_count").orderBy(F.desc("flight_count"), "airline")


def altitude_distribution(counts: DataFrame, as_of: Column | datetime) -> DataFrame:
    """``activity.altitude_distribution`` from the counts."""
    return _of(counts, BAND, as_of, "band", "flight_count")


def country_activity(counts: DataFrame, as_of: Column | datetime, limit: int = 20) -> DataFrame:
    """``activity.country_activity`` from the counts."""
    held = _of(counts, FLYING_COUNTRY, as_of, "origin_country", "flights_now")
    return top_rows(held, [F.desc("flights_now"), F.asc("origin_country")], limit)


def dashboard_stats(counts: DataFrame, as_of: Column | datetime) -> DataFrame:
    """``activity.dashboard_stats`` by the age rule, from the counts."""
    held = retain(counts, "ingested_at", as_of, K.LIVE_RETENTION)
    by_key = held.groupBy("view", "key").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("ingested_at") < S.moment(as_of) - F.lit(K.GHOST_AGE), F.col("n"))).alias("old"),
        F.max("ingested_at").alias("last"),
    )
    total = lambda n, view, key: F.coalesce(F.sum(F.when((F.col("view") == view) & (F.col("key") == key), F.col(n))), F.lit(0))
    stats = by_key.where("n > 0").agg(
        total("n", PLACE, AIR).alias("flights_in_air"),
        total("n", PLACE, GROUND).alias("flights_on_ground"),
        F.count_if(F.col("view") == COUNTRY).alias("countries_active"),
        total("old", PLACE, AIR).alias("ghost_count"),
        F.max("last").alias("last_ingested_at"),
    )
    seconds = F.round(S.seconds_between(F.col("last_ingested_at"), S.moment(as_of))).cast("int")
    return stats.withColumn("seconds_since_sync", seconds)
