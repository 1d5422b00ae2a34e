"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("states", T.ArrayType(T.StringType())),  # each as its JSON text, whatever it is
])

STATE = T.StructType([
    T.StructField("icao24", T.StringType()),
    T.StructField("callsign", T.StringType()),
    T.StructField("origin_country", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("baro_altitude", T.DoubleType()),
    T.StructField("geo_altitude", T.DoubleType()),
    T.StructField("on_ground", T.BooleanType()),
    T.StructField("velocity", T.DoubleType()),
    T.StructField("true_track", T.DoubleType()),
    T.StructField("vertical_rate", T.DoubleType()),
])

LIVE = T.StructType(STATE.fields + [T.StructField("ingested_at", T.TimestampNTZType())])

ANOMALY_HOURLY = T.StructType([
    T.StructField("hour_utc", T.TimestampNTZType()),
    T.StructField("ghost_count", T.IntegerType()),
    T.StructField("low_alt_count", T.IntegerType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

RUNS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("run_at", T.TimestampNTZType()),
    T.StructField("records_fetched", T.IntegerType()),
    T.StructField("records_upserted", T.IntegerType()),
    T.StructField("fetch_ms", T.IntegerType()),
    T.StructField("upsert_ms", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_msg", T.StringType()),
])

ALERTS = T.StructType([
    T.StructField("cycle", T.TimestampNTZType()),
    T.StructField("icao24", T.StringType()),
    T.StructField("message", T.StringType()),
])

#: Parsed vectors as the streams hand them on, the rejected ones with the reason; `cycle` is the snapshot they count to.
OBSERVED = T.StructType([
    *STATE.fields,
    T.StructField("time", T.LongType()),
    T.StructField("cycle", T.LongType()),
    T.StructField("landed", T.TimestampType()),
    T.StructField("file", T.LongType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("reject_reason", T.StringType()),
])

#: A sketch of the aircraft in the air in an hour.
SKETCHES = T.StructType([
    T.StructField("hs", T.TimestampNTZType()),
    T.StructField("sketch", T.BinaryType()),
])

#: How many live rows of an ingest time have a property.
COUNTS = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("n", T.LongType()),
])

STATE_COLUMNS = STATE.fieldNames()
LIVE_COLUMNS = LIVE.fieldNames()
