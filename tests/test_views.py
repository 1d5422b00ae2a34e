from fixed_time import NOW
from skywake.plans.views import register_views


def test_views_answer_the_dashboard_queries(spark, live_rows, run_rows, ago):
    live = live_rows([
        {"icao24": "a", "callsign": "BA1", "origin_country": "Spain", "ingested_at": ago(minutes=3)},
        {"icao24": "b", "callsign": "BA2", "geo_altitude": 100.0},
    ])
    log = run_rows([{"records_upserted": 7}])
    hourly = spark.createDataFrame([(NOW, 1, 2)], "hour_utc timestamp_ntz, ghost_count int, low_alt_count int")
    register_views(live, log, hourly, NOW)
    first = lambda sql: [tuple(row) for row in spark.sql(sql).collect()]
    assert first("SELECT * FROM airline_activity LIMIT 10") == [("British Airways", 2)]
    assert first("SELECT icao24 FROM ghost_flights WHERE minutes_since_contact <= 15 LIMIT 10000") == [("a",)]
    assert first("SELECT flights_in_air, ghost_count FROM dashboard_stats") == [(2, 1)]
    assert first("SELECT * FROM country_activity LIMIT 20") == [("Spain", 1)]
    assert first("SELECT band FROM altitude_distribution ORDER BY band") == [("Ground",), ("Low",)]
    congestion = first("SELECT * FROM get_hourly_congestion()")
    assert len(congestion) == 24 and congestion[-1] == ("13:00", 7)
    assert first("SELECT sum(records_upserted) FROM pipeline_runs WHERE status = 'success'") == [(7,)]
    assert first("SELECT ghost_count FROM anomaly_hourly") == [(1,)]
