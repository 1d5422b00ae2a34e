"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywake import constants as K
from skywake.functions import scalars as S
from skywake.operators import activity, anomalies, ghosts, maintenance, nearest, positions, ranking, regions, runs, snapshots
from skywake.plans.inputs import Inputs
from skywake.schemas import LIVE_COLUMNS, SKETCHES, STATE_COLUMNS
from skywake.session import work_path
from skywake.sources import files, large, snapshots as wire
from skywake.sources.tables import BatchLog, Store, in_view, read_history, write_by_place, write_history
from skywake.streaming import ingest, signals

#: Buckets of the live table and of the keyed state, for tables of test size.
BUCKETS = 16
VIEW = (20.0, -30.0, 60.0, 60.0)  # south, west, north, east
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    return build


def recent(i: Inputs, live: DataFrame | None = None) -> DataFrame:
    return ghosts.scan_recent_ghosts(live or i.live, i.as_of, i.runs)


def enriched(i: Inputs) -> DataFrame:
    live = i.stored_live
    return ghosts.enrich_ghosts(recent(i, live), live, ghosts.snapshot_health(live, i.as_of))


def window(i: Inputs) -> DataFrame:
    return anomalies.scan_anomaly_window(i.anomalies, i.as_of)


def congestion(i: Inputs) -> DataFrame:
    return runs.congestion_hours(i.runs, i.as_of)


# Sources and scans


@query
def scan_state_snapshots(i: Inputs) -> DataFrame:
    scanned = wire.scan_state_snapshots(i.spark, i.write_documents(), multi_line=False)
    return wire.valid_states(wire.parse_states(scanned)).select("time", *STATE_COLUMNS)


@query
def scan_large_documents(i: Inputs) -> DataFrame:
    scanned = large.scan_large_documents(i.spark, i.write_large_documents())
    return wire.valid_states(wire.parse_states(scanned)).select("time", *STATE_COLUMNS)


@query
def scan_live_positions(i: Inputs) -> DataFrame:
    return positions.scan_live_positions(i.live)


@query
def scan_recent_ghosts(i: Inputs) -> DataFrame:
    return recent(i)


@query
def scan_anomaly_window(i: Inputs) -> DataFrame:
    return window(i)


@query
def scan_runs_today(i: Inputs) -> DataFrame:
    return runs.scan_runs_today(i.runs, i.as_of)


@query
def recent_runs(i: Inputs) -> DataFrame:
    return runs.recent_runs(i.runs)


@query
def altitude_profile(i: Inputs) -> DataFrame:
    return positions.altitude_profile(i.history, ["ingested_at", "event_id"])


@query
def scan_congestion(i: Inputs) -> DataFrame:
    return runs.hourly_congestion(i.runs, i.as_of)


# Sinks and table maintenance


@query
def upsert_live(i: Inputs) -> DataFrame:
    batch = i.history.where(F.col("ingested_at") > i.before)
    return snapshots.upsert_live(i.live_before, batch, i.newest, i.as_of)


@query
def append_history(i: Inputs) -> DataFrame:
    path = work_path(i.spark, "history")
    snapshots.append_history(i.history.select(*LIVE_COLUMNS), path)
    return i.spark.read.parquet(path).select(*LIVE_COLUMNS, F.hour("ingest_hour").alias("folder_hour"))


@query
def log_run(i: Inputs) -> DataFrame:
    batch = i.history.where(F.col("ingested_at") > i.before)
    nothing = i.history.where(F.col("ingested_at") > i.as_of)
    return snapshots.run_row(batch, i.as_of, 120, 340, 1).unionByName(
        snapshots.run_row(nothing, i.as_of, 120, 340, 2)
    )


@query
def upsert_anomaly_hour(i: Inputs) -> DataFrame:
    kept = snapshots.purge_stale_live(i.live, i.as_of)
    return anomalies.upsert_anomaly_hour(i.anomalies, anomalies.anomaly_hour_rollup(kept, i.as_of))


@query
def purge_stale_live(i: Inputs) -> DataFrame:
    return snapshots.purge_stale_live(i.live, i.as_of)


@query
def purge_history(i: Inputs) -> DataFrame:
    """Ten minutes after the last event, since the log spans just the hour before it."""
    later = i.as_of + F.lit(timedelta(minutes=10))
    return snapshots.purge_history(i.history, later).select("event_id", *LIVE_COLUMNS)


@query
def purge_anomaly_hourly(i: Inputs) -> DataFrame:
    return snapshots.purge_anomaly_hourly(i.anomalies, i.as_of)


@query
def purge_runs(i: Inputs) -> DataFrame:
    return snapshots.purge_runs(i.runs, i.as_of)


@query
def table_counts(i: Inputs) -> DataFrame:
    return snapshots.table_counts({"live": i.live, "anomaly": i.anomalies, "run": i.runs})


# Parsing, projections, filters


@query
def parse_states(i: Inputs) -> DataFrame:
    return wire.parse_states(i.vectors)


@query
def valid_states(i: Inputs) -> DataFrame:
    return wire.valid_states(wire.parse_states(i.vectors))


@query
def airborne_only(i: Inputs) -> DataFrame:
    return snapshots.airborne_only(i.history).select("event_id", *LIVE_COLUMNS)


@query
def airborne_positioned(i: Inputs) -> DataFrame:
    return positions.airborne_positioned(i.live)


@query
def positioned(i: Inputs) -> DataFrame:
    return positions.positioned(i.live).select("icao24", "lat", "lon", "on_ground")


@query
def convert_units(i: Inputs) -> DataFrame:
    return positions.convert_units(i.live)


@query
def airline_name(i: Inputs) -> DataFrame:
    name = S.airline_name(F.col("callsign"))
    longest = S.airline_name(F.col("callsign"), longest_prefix=True)
    return i.live.select("icao24", name.alias("airline"), longest.alias("airline_longest_prefix"))


@query
def altitude_band(i: Inputs) -> DataFrame:
    return i.live.select("icao24", S.altitude_band(F.col("on_ground"), F.col("geo_altitude")).alias("band"))


@query
def performance_band3(i: Inputs) -> DataFrame:
    return i.live.select("icao24", S.performance_band3(F.col("geo_altitude")).alias("band"))


@query
def performance_band5(i: Inputs) -> DataFrame:
    return i.live.select("icao24", S.performance_band5(F.col("geo_altitude")).alias("band"))


@query
def is_low_altitude(i: Inputs) -> DataFrame:
    low = S.is_low_altitude(F.col("on_ground"), F.col("geo_altitude"))
    return i.live.select("icao24", low.alias("is_low"))


@query
def is_ghost(i: Inputs) -> DataFrame:
    return i.live.select(
        "icao24",
        ghosts.is_ghost(runs=i.runs).alias("by_run"),
        ghosts.is_ghost(as_of=i.as_of).alias("by_age"),
    )


@query
def flight_card(i: Inputs) -> DataFrame:
    return positions.flight_cards(positions.scan_live_positions(i.stored_live), enriched(i))


@query
def ghost_table_rows(i: Inputs) -> DataFrame:
    return ghosts.ghost_table_rows(recent(i))


@query
def feed_message(i: Inputs) -> DataFrame:
    kind = (
        F.when(ghosts.is_ghost(as_of=i.as_of), "ghost")
        .when(F.col("geo_altitude") > K.CRUISE_EVENT_METERS, "cruise")
        .otherwise("contact")
    )
    text = S.feed_message(
        F.col("kind"), F.col("callsign"), F.col("icao24"), F.col("origin_country"), F.col("geo_altitude")
    )
    return i.live.withColumn("kind", kind).select("icao24", "kind", text.alias("message"))


@query
def hour_label(i: Inputs) -> DataFrame:
    return i.history.select("event_id", S.hour_label(F.col("ingested_at")).alias("label"))


@query
def bbox_filter(i: Inputs) -> DataFrame:
    return positions.bbox_filter(i.live, *VIEW)


# Joins and subqueries


@query
def last_success_threshold(i: Inputs) -> DataFrame:
    return ghosts.last_success_threshold(i.runs)


@query
def region_membership(i: Inputs) -> DataFrame:
    return regions.region_membership(i.live).select("icao24", "region")


@query
def enrich_ghosts(i: Inputs) -> DataFrame:
    return enriched(i)


@query
def new_ghosts(i: Inputs) -> DataFrame:
    now, before = (i.stored_cycles.where(F.col("cycle") == at).drop("cycle") for at in (i.as_of, i.before))
    return ghosts.new_ghosts(ghosts.ghosts_of(now, i.as_of), ghosts.ghosts_of(before, i.before))


@query
def non_ghost_flights(i: Inputs) -> DataFrame:
    return positions.non_ghost_flights(i.stored_live, recent(i, i.stored_live))


@query
def ghost_flag(i: Inputs) -> DataFrame:
    return positions.ghost_flag(positions.positioned(i.stored_live), recent(i, i.stored_live)).select("icao24", "is_ghost")


@query
def hour_spine_join(i: Inputs) -> DataFrame:
    return congestion(i)


@query
def band_spine_join(i: Inputs) -> DataFrame:
    return activity.band_spine(activity.altitude_distribution(i.live))


@query
def nearest_aircraft(i: Inputs) -> DataFrame:
    return nearest.nearest_aircraft(i.points, i.live, zoom=3)


# Aggregations


@query
def airline_activity(i: Inputs) -> DataFrame:
    return activity.airline_activity(i.live)


@query
def altitude_distribution(i: Inputs) -> DataFrame:
    return activity.altitude_distribution(i.live)


@query
def country_activity(i: Inputs) -> DataFrame:
    return activity.country_activity(i.live)


@query
def ghost_flights(i: Inputs) -> DataFrame:
    return ghosts.ghost_flights(i.live, i.as_of, i.runs)


@query
def ghost_flights_by_age(i: Inputs) -> DataFrame:
    return ghosts.ghost_flights(i.live, i.as_of)


@query
def dashboard_stats(i: Inputs) -> DataFrame:
    return activity.dashboard_stats(i.live, i.as_of, i.runs)


@query
def anomaly_hour_rollup(i: Inputs) -> DataFrame:
    return anomalies.anomaly_hour_rollup(snapshots.purge_stale_live(i.live, i.as_of), i.as_of)


@query
def hourly_congestion(i: Inputs) -> DataFrame:
    return runs.hourly_congestion(i.runs, i.as_of)


@query
def region_table_membership(i: Inputs) -> DataFrame:
    return regions.region_table_membership(i.stored_live, i.regions).select("region", "icao24")


@query
def region_table_traffic(i: Inputs) -> DataFrame:
    return regions.region_table_traffic(i.stored_live, i.regions)


@query
def region_traffic(i: Inputs) -> DataFrame:
    return regions.region_traffic(i.live)


@query
def region_scores(i: Inputs) -> DataFrame:
    return regions.region_scores(i.live)


@query
def longitude_density(i: Inputs) -> DataFrame:
    return regions.longitude_density(i.live)


@query
def density_levels(i: Inputs) -> DataFrame:
    return regions.density_levels(regions.longitude_density(i.live))


@query
def heat_points(i: Inputs) -> DataFrame:
    return regions.heat_points(i.live)


@query
def density_grid(i: Inputs) -> DataFrame:
    return regions.density_grid(i.live, 5.0)


@query
def country_speed(i: Inputs) -> DataFrame:
    return activity.country_speed(i.live)


@query
def alert_distribution(i: Inputs) -> DataFrame:
    return anomalies.alert_distribution(window(i))


@query
def records_today(i: Inputs) -> DataFrame:
    return runs.records_today(i.runs, i.as_of)


@query
def run_metrics(i: Inputs) -> DataFrame:
    return runs.run_metrics(i.runs)


@query
def tracked_flights(i: Inputs) -> DataFrame:
    return activity.tracked_flights(i.live)


@query
def congestion_total(i: Inputs) -> DataFrame:
    return runs.congestion_total(congestion(i))


@query
def snapshot_health(i: Inputs) -> DataFrame:
    return ghosts.snapshot_health(i.live, i.as_of)


# Window-like computations


@query
def band_shares(i: Inputs) -> DataFrame:
    return activity.band_shares(activity.altitude_distribution(i.live))


@query
def country_share(i: Inputs) -> DataFrame:
    return activity.country_share(activity.country_activity(i.live))


@query
def airline_bars(i: Inputs) -> DataFrame:
    return activity.airline_bars(i.live)


@query
def airline_race(i: Inputs) -> DataFrame:
    return activity.airline_race(i.live)


@query
def congestion_peak(i: Inputs) -> DataFrame:
    return runs.congestion_peak(congestion(i))


@query
def morning_night_peaks(i: Inputs) -> DataFrame:
    return runs.morning_night_peaks(congestion(i))


@query
def congestion_bars(i: Inputs) -> DataFrame:
    return runs.congestion_bars(congestion(i))


@query
def activity_clock(i: Inputs) -> DataFrame:
    return runs.activity_clock(congestion(i), i.as_of)


@query
def anomaly_peak(i: Inputs) -> DataFrame:
    return anomalies.anomaly_peak(anomalies.anomaly_timeline(window(i)))


@query
def latest_by_key(i: Inputs) -> DataFrame:
    return i.live


@query
def anomaly_timeline(i: Inputs) -> DataFrame:
    return anomalies.anomaly_timeline(window(i))


@query
def region_trend(i: Inputs) -> DataFrame:
    return regions.region_trend(i.cycles)


# Sort, limit, pages, samples


@query
def ghost_alerts(i: Inputs) -> DataFrame:
    return ghosts.ghost_alerts(recent(i)).select("icao24", "callsign", "origin_country", "ingested_at")


@query
def page_of(i: Inputs) -> DataFrame:
    rows = recent(i, i.stored_live).select("icao24", "callsign", "ingested_at")
    return ranking.page_of(rows, ["ingested_at", "icao24"], page=3)


@query
def page_after(i: Inputs) -> DataFrame:
    """The page behind a row, over a key with nulls in descending order."""
    rows = i.live.select("callsign", "icao24")
    return ranking.page_after(rows, [("callsign", True), "icao24"], ["BA1000", ""], 30).unionByName(
        ranking.page_after(rows, [("callsign", True), "icao24"], [None, "100"], 30)
    )


@query
def systematic_sample(i: Inputs) -> DataFrame:
    return ranking.systematic_sample(positions.positioned(i.stored_live), 500).select("icao24")


@query
def zoom_sample(i: Inputs) -> DataFrame:
    """The three zoom ranges of the map, over the history log."""
    log = i.history.select("event_id", "icao24", "lat", "lon")
    return ranking.zoom_samples(log, [3, 5, 7], VIEW, ["icao24", "event_id"]).select("zoom", "icao24", "event_id")


@query
def performance_scatter(i: Inputs) -> DataFrame:
    return positions.performance_scatter(i.live)


@query
def performance_scatter_wide(i: Inputs) -> DataFrame:
    return positions.performance_scatter(i.live, wide=True)


# Streaming


#: Files of a batch where a query is to see several batches, and most of such batches: what lands in one batch grows with the tables,
#: since each batch goes through the whole live table.
BATCH_FILES, BATCHES = 2, 4


def _batch_files(spark: SparkSession, landing: str) -> int:
    """Files of a batch such that all that lie in a folder come in several batches, however many files they are."""
    landed = sum(not name.startswith(("_", ".")) for name in files.names(spark, landing))
    return max(BATCH_FILES, -(-landed // BATCHES))


def _ingested(i: Inputs, batches: bool = False) -> Store:
    """Run the ingestion stream over snapshot documents of the whole event table, at once or in several batches."""
    store = Store(i.spark, work_path(i.spark, "state"), BUCKETS)
    landing = i.write_documents()
    most = _batch_files(i.spark, landing) if batches else None
    stream = ingest.start_ingest(i.spark, landing, store.root, work_path(i.spark, "offsets"), most, buckets=BUCKETS)
    stream.awaitTermination()
    return store


#: Vectors for which the keyed state of a larger table has one bucket.
BUCKET_VECTORS = 25_000


def _signal_buckets(store: Store) -> int:
    """Buckets of the keyed state such that one holds little of a large table, as it is one call's work."""
    return max(BUCKETS, min(signals.BUCKETS, store.observed.read().count() // BUCKET_VECTORS))


def _signalled(i: Inputs) -> Store:
    """Run both streams, ingestion and what follows it."""
    store = Store(i.spark, work_path(i.spark, "state"), BUCKETS)
    landing = i.write_documents()
    i.write_closing_document(landing, signals.LATENESS + timedelta(seconds=1))
    ingest.start_ingest(i.spark, landing, store.root, work_path(i.spark, "offsets"), buckets=BUCKETS).awaitTermination()
    signals.start_signals(i.spark, store, work_path(i.spark, "signal-offsets"), buckets=_signal_buckets(store)).awaitTermination()
    return store


@query
def stream_ingest(i: Inputs) -> DataFrame:
    return _ingested(i).live.current()


@query
def stream_hourly_rollup(i: Inputs) -> DataFrame:
    return signals.hourly(_signalled(i))


@query
def stream_new_ghosts(i: Inputs) -> DataFrame:
    return signals.alerts(_signalled(i))


@query
def stream_runs(i: Inputs) -> DataFrame:
    return _ingested(i).run_log().drop("fetch_ms", "upsert_ms")


def _counted(i: Inputs) -> tuple[DataFrame, Column]:
    """The counts kept by the ingestion stream over several batches, and its last accepted snapshot."""
    store = _ingested(i, batches=True)
    good = store.run_log().where("status = 'success'")
    return store.current_counts(), good.agg(F.max("run_at")).scalar()


@query
def kept_airline_activity(i: Inputs) -> DataFrame:
    return maintenance.airline_activity(*_counted(i))


@query
def kept_altitude_distribution(i: Inputs) -> DataFrame:
    return maintenance.altitude_distribution(*_counted(i))


@query
def kept_country_activity(i: Inputs) -> DataFrame:
    return maintenance.country_activity(*_counted(i))


@query
def kept_dashboard_stats(i: Inputs) -> DataFrame:
    return maintenance.dashboard_stats(*_counted(i))


@query
def live_feed(i: Inputs) -> DataFrame:
    return ghosts.live_feed(i.stored_uneven_cycles)


@query
def live_feed_by_runs(i: Inputs) -> DataFrame:
    return ghosts.live_feed(i.stored_uneven_cycles, i.runs)


@query
def history_hourly_sketch(i: Inputs) -> DataFrame:
    """For each hour, whether the sketches that several batches of the stream left, merged, are within the stated error of the exact count."""
    path = work_path(i.spark, "history")
    sketches = BatchLog(i.spark, work_path(i.spark, "sketches"), SKETCHES)
    offsets = work_path(i.spark, "offsets")
    landing = i.write_documents()
    most = _batch_files(i.spark, landing)
    ingest.start_history(i.spark, landing, path, offsets, most, keep=None, sketches=sketches).awaitTermination()
    exact = anomalies.history_hourly(read_history(i.spark, path))
    estimated = anomalies.merged_hourly(sketches.read()).withColumnRenamed("aircraft", "estimate")
    near = F.abs(F.col("estimate") - F.col("aircraft")) <= F.col("aircraft") * anomalies.SKETCH_ERROR
    return exact.join(estimated, "hs", "full_outer").select("hs", F.coalesce(near, F.lit(False)).alias("within"))


@query
def altitude_profile_of(i: Inputs) -> DataFrame:
    """The altitude curve of the aircraft seen most, looked up in the stored log."""
    path = work_path(i.spark, "history")
    write_history(wire.accept_typed(i.states), 0, path)
    seen = i.states.where("NOT on_ground AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("icao24").count()
    most = seen.orderBy(F.desc("count"), "icao24").first()["icao24"]
    points = ["ingested_at", "lon", "lat", "velocity"]
    return positions.altitude_profile(read_history(i.spark, path), points, most)


@query
def bbox_by_place(i: Inputs) -> DataFrame:
    """The map view, read from the live table stored along the Z curve."""
    path = work_path(i.spark, "places")
    write_by_place(i.live, path)
    stored = i.spark.read.parquet(path)
    return in_view(stored, *VIEW)


@query
def history_hourly(i: Inputs) -> DataFrame:
    observed = i.history.withColumn("ingested_at", F.timestamp_micros("ts_us").cast("timestamp_ntz"))
    return anomalies.history_hourly(observed)
