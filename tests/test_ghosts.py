from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixed_time import NOW
from skywake.operators import ghosts, positions


def ids(frame):
    return [row.icao24 for row in frame.collect()]


@pytest.fixture
def aged(live_rows, ago):
    return live_rows([
        {"icao24": "at", "ingested_at": ago(seconds=30)},
        {"icao24": "over", "ingested_at": ago(seconds=30, microseconds=1)},
        {"icao24": "ground", "ingested_at": ago(hours=1), "on_ground": True},
        {"icao24": "fresh"},
        {"icao24": "two", "ingested_at": ago(minutes=2)},
        {"icao24": "beyond", "ingested_at": ago(minutes=2, microseconds=1)},
        {"icao24": "quarter", "ingested_at": ago(minutes=15)},
        {"icao24": "older", "ingested_at": ago(minutes=15, seconds=1)},
    ])


def test_run_rule_uses_the_last_success(aged, run_rows, ago):
    log = run_rows([{"run_at": NOW}, {"run_at": NOW + timedelta(minutes=5), "status": "error"}])
    assert ids(ghosts.ghost_flights(aged, NOW, log)) == ["older", "quarter", "beyond", "two", "over"]


def test_without_a_success_there_are_no_ghosts(aged, run_rows):
    assert ids(ghosts.ghost_flights(aged, NOW, run_rows([{"status": "error"}]))) == []
    assert ids(ghosts.ghost_flights(aged, NOW, run_rows([]))) == []


def test_age_rule(aged):
    assert ids(ghosts.ghost_flights(aged, NOW)) == ["older", "quarter", "beyond"]


def test_recent_ghosts_include_the_quarter_hour(aged):
    assert sorted(ids(ghosts.scan_recent_ghosts(aged, NOW))) == ["beyond", "quarter"]


def test_altitude_and_minutes(live_rows, ago):
    row = ghosts.ghost_flights(live_rows([{"geo_altitude": 100.0, "ingested_at": ago(seconds=150)}]), NOW).collect()[0]
    assert (row.altitude_ft, row.minutes_since_contact) == (328.0, 2.5)


@pytest.mark.parametrize(("seconds", "down"), [(3600, False), (3601, True)])
def test_outage_suppresses_enriched_ghosts(live_rows, ago, seconds, down):
    live = live_rows([{"icao24": "a", "lat": 1.0, "lon": 1.0, "velocity": 5.0, "ingested_at": ago(seconds=seconds)}])
    lost = ghosts.ghosts_of(live, NOW)
    health = ghosts.snapshot_health(live, NOW)
    assert health.collect()[0].pipeline_down is down
    found = ghosts.enrich_ghosts(lost, live, health).collect()
    assert [row.velocity for row in found] == ([] if down else [5.0])


def test_health_of_an_empty_table(live_rows):
    row = ghosts.snapshot_health(live_rows([]), NOW).collect()[0]
    assert (row.seconds_since_sync, row.pipeline_down) == (None, False)


def test_ghost_without_position_in_live_keeps_its_own_fields(live_rows, ago):
    live = live_rows([{"icao24": "a", "velocity": 5.0, "ingested_at": ago(minutes=3)}, {"icao24": "b"}])
    row = ghosts.enrich_ghosts(ghosts.ghosts_of(live, NOW), live, ghosts.snapshot_health(live, NOW)).collect()[0]
    assert (row.icao24, row.velocity) == ("a", None)


def test_new_ghosts_against_the_cycle_before(aged):
    now = ghosts.ghosts_of(aged, NOW)
    before = now.where("icao24 <> 'beyond'")
    assert ids(ghosts.new_ghosts(now, before)) == ["beyond"]
    assert ghosts.new_ghosts(now, before.limit(0)).count() == 3


def test_flight_card_text(live_rows):
    live = live_rows([
        {"icao24": "a", "callsign": "", "geo_altitude": 10668.0, "velocity": 250.0, "true_track": 89.5},
        {"icao24": "b", "callsign": "BA1", "origin_country": "Spain", "geo_altitude": 0.0, "velocity": 0.0},
    ])
    first, second = positions.flight_cards(live, live.where("icao24 = 'b'")).orderBy("icao24").collect()
    assert tuple(first) == ("a", "a", "—", "35,000 ft", "486 kts", "90°", "LIVE")
    assert tuple(second) == ("BA1", "b", "Spain", "—", "—", "—", "SIGNAL LOST")


def test_ghost_table_text(live_rows, ago):
    live = live_rows([
        {"icao24": "a", "lat": -33.5, "lon": 151.25, "geo_altitude": 1000.0, "ingested_at": ago(seconds=150)},
        {"icao24": "b", "ingested_at": ago(seconds=140)},
    ])
    rows = ghosts.ghost_table_rows(ghosts.ghost_flights(live, NOW)).orderBy("icao24").collect()
    assert tuple(rows[0]) == ("a", "a", "—", "-33.5000° N, 151.2500° E", "3m ago", "3,281")
    assert tuple(rows[1]) == ("b", "b", "—", "—, —", "2m ago", "—")


def test_feed_lists_the_newest_cycle_first(spark, live_rows, ago):
    def at(minutes, rows):
        return live_rows(rows).withColumn("cycle", F.lit(ago(minutes=minutes).isoformat(sep=" ")).cast("timestamp_ntz"))

    first = at(3, [
        {"icao24": "old", "ingested_at": ago(minutes=6)},
        {"icao24": "c1", "lat": 1.0, "lon": 1.0, "geo_altitude": 9500.0, "ingested_at": ago(minutes=3)},
    ])
    second = at(0, [
        {"icao24": "old", "ingested_at": ago(minutes=6)},
        {"icao24": "c1", "lat": 1.0, "lon": 1.0, "geo_altitude": 9500.0, "ingested_at": ago(minutes=3)},
        {"icao24": "c2", "callsign": "BA2", "lat": 1.0, "lon": 1.0, "geo_altitude": 10000.0},
        {"icao24": "low", "lat": 1.0, "lon": 1.0, "geo_altitude": 9000.0},
    ])
    feed = ghosts.live_feed(first.unionByName(second)).collect()
    assert [(row.kind, row.icao24) for row in feed] == [
        ("ghost", "c1"),
        ("cruise", "c2"),
        ("ghost", "old"),
        ("cruise", "c1"),
    ]
    assert feed[1].message == "BA2 reached cruise altitude 32,808 ft"
    assert len(ghosts.live_feed(first.unionByName(second), size=3).collect()) == 3
