from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fixed_time import NOW
from skywake import constants as K
from skywake.operators import activity, anomalies, regions, runs


def pairs(frame, *names):
    return [tuple(row[n] for n in names) for row in frame.collect()]


def test_airlines_count_blank_callsigns_as_other(live_rows):
    live = live_rows([{"callsign": c} for c in ["BA1", "BA2", "DLH1", "", None]] + [{"callsign": "BA3", "on_ground": True}])
    assert pairs(activity.airline_activity(live), "airline", "flight_count") == [
        ("British Airways", 2),
        ("Delta", 1),
        ("Other", 1),
    ]


def test_race_drops_other_after_the_first_ten(live_rows):
    prefixes = [prefixes[1] for _, prefixes in K.AIRLINE_PREFIXES[:10]]
    live = live_rows([{"callsign": "ZZ"}] * 30 + [{"callsign": p} for n, p in enumerate(prefixes) for _ in range(n + 1)])
    race = activity.airline_race(live).collect()
    assert len(race) == 9 and race[0]["rank"] == 1 and race[0].width_pct == 100
    assert "Other" not in [row.airline for row in race]
    bars = activity.airline_bars(live).orderBy("rank").collect()
    assert (len(bars), bars[0].airline, sum(row.in_race for row in bars)) == (7, "Other", 5)
    assert activity.tracked_flights(live).collect()[0].tracked_flights == 30 + sum(range(2, 11))


def test_bands_fill_the_spine_and_sum_to_all_rows(live_rows):
    live = live_rows([{"geo_altitude": 100.0}, {"geo_altitude": 12000.0}, {"geo_altitude": None}, {"on_ground": True}])
    shares = activity.band_shares(activity.altitude_distribution(live)).orderBy("ord").collect()
    assert [row.flight_count for row in shares] == [2, 1, 0, 1, 0]
    assert [row.percent for row in shares] == [50, 25, 0, 25, 0]
    assert [(row.slice_start, row.slice_end) for row in shares] == [(0, 0.5), (0.5, 0.75), (0.75, 0.75), (0.75, 1), (1, 1)]


def test_bands_of_an_empty_table(live_rows):
    shares = activity.band_shares(activity.altitude_distribution(live_rows([]))).collect()
    assert [row.fraction for row in shares] == [0.0] * 5


def test_country_share_refers_to_the_list(live_rows):
    rows = [{"origin_country": "A"}] * 5 + [{"origin_country": f"C{n:02d}"} for n in range(25)]
    countries = activity.country_activity(live_rows(rows))
    assert countries.count() == 20
    first = activity.country_share(countries).collect()[0]
    assert (first["rank"], first.origin_country, first.share_pct) == (1, "A", "20.8")
    assert activity.country_share(countries, total=F.lit(30)).collect()[0].share_pct == "16.7"


def test_countries_and_distribution_by_cycle(live_rows):
    live = live_rows([{"origin_country": c} for c in "AAB"]).withColumn("cycle", F.lit(1))
    both = live.unionByName(live.where("origin_country = 'B'").withColumn("cycle", F.lit(2)))
    got = sorted(pairs(activity.country_activity(both, ["cycle"], limit=1), "cycle", "origin_country", "flights_now"))
    assert got == [(1, "A", 2), (2, "B", 1)]
    assert sorted(pairs(activity.altitude_distribution(both, ["cycle"]), "cycle", "flight_count")) == [(1, 3), (2, 1)]
    assert sorted(pairs(activity.airline_counts(both.fillna("BA"), ["cycle"]), "cycle", "flight_count")) == [(1, 3), (2, 1)]


def test_dashboard_counts_countries_on_the_ground_too(live_rows, run_rows):
    live = live_rows([{"origin_country": "A", "on_ground": True}, {"origin_country": "B"}, {}])
    row = activity.dashboard_stats(live, NOW + timedelta(seconds=2.5), run_rows([])).collect()[0]
    assert tuple(row) == (2, 1, 2, 0, NOW, 3)


def test_dashboard_of_an_empty_table(live_rows, run_rows):
    assert tuple(activity.dashboard_stats(live_rows([]), NOW, run_rows([])).collect()[0]) == (0, 0, 0, 0, None, None)


def test_country_speed_needs_three_and_ranks_by_rounded_average(live_rows):
    at = {"lat": 1.0, "lon": 1.0}
    rows = [{**at, "origin_country": c, "velocity": v} for c, v in [("B", 200.0), ("A", 200.1), ("C", 300.0)] for _ in range(3)]
    rows[-1]["velocity"] = 0.0
    got = activity.country_speed(live_rows(rows)).orderBy("rank").collect()
    assert [(r.origin_country, r.avg_kt, r.n, r.width_pct, r.diff_kt) for r in got] == [
        ("A", 389, 3, 100, -71),
        ("B", 389, 3, 100, -71),
    ]


def test_regions_include_their_edges_and_overlap(live_rows):
    places = [(36.0, 0.0), (15.0, -60.0), (90.0, 0.0), (34.0, -25.0)]
    live = live_rows([{"lat": lat, "lon": lon} for lat, lon in places] + [{"lat": 36.0, "lon": 0.0, "on_ground": True}])
    found = sorted(pairs(regions.region_membership(live), "icao24", "region"))
    assert found == [
        ("a00000", "Africa"),
        ("a00000", "Europe"),
        ("a00001", "North America"),
        ("a00001", "South America"),
        ("a00003", "Europe"),
    ]
    traffic = pairs(regions.region_traffic(live), "region", "flight_count")
    assert traffic[:4] == [("Europe", 2), ("North America", 1), ("South America", 1), ("Africa", 1)]
    assert len(traffic) == 7
    scores = dict(pairs(regions.region_scores(live), "region", "score"))
    assert len(scores) == 8 and scores["Europe"] == 100 and scores["Africa"] == 50


def test_regions_of_an_empty_table(live_rows):
    assert pairs(regions.region_scores(live_rows([])), "score") == [(0,)] * 8


def test_region_trend(live_rows):
    europe = {"lat": 50.0, "lon": 10.0}
    one = live_rows([europe] * 2).withColumn("cycle", F.lit(1))
    two = live_rows([europe] * 3).withColumn("cycle", F.lit(2))
    rows = {(r.cycle, r.region): r for r in regions.region_trend(one.unionByName(two)).collect()}
    assert len(rows) == 14
    assert (rows[2, "Europe"].change_pct, rows[2, "Europe"].direction) == (50, "up")
    assert (rows[1, "Europe"].change_pct, rows[2, "Africa"].change_pct) == (None, None)


def test_longitude_strip(live_rows):
    live = live_rows([{"lon": x} for x in (-180.0, 179.999, 180.0, None)] + [{"lon": 0.0, "on_ground": True}])
    levels = regions.density_levels(regions.longitude_density(live)).orderBy("bin").collect()
    assert len(levels) == 72
    assert [row.bin for row in levels if row.flight_count] == [0, 71]
    assert (levels[0].level, levels[1].level, levels[1].height_pct) == ("high", "minimal", 2.0)


def test_density_grid_counts_negative_cells(live_rows):
    live = live_rows([{"lat": -0.5, "lon": 0.5}, {"lat": -0.1, "lon": 0.9}, {"lat": 0.0, "lon": 0.0}])
    got = sorted(pairs(regions.density_grid(live), "lat_cell", "lon_cell", "weight"))
    assert got == [(-1, 0, 2), (0, 0, 1)]


def hour(back):
    return NOW.replace(minute=5, second=0) - timedelta(hours=back)


def test_congestion_drops_the_partial_oldest_hour(run_rows):
    log = run_rows([
        {"run_at": NOW - timedelta(hours=23, minutes=55), "records_upserted": 99},
        {"run_at": hour(1), "records_upserted": 2},
        {"run_at": hour(1), "records_upserted": 3},
        {"run_at": hour(2), "records_upserted": 7, "status": "error"},
        {"run_at": hour(4), "records_upserted": None},
    ])
    got = pairs(runs.hourly_congestion(log, NOW), "hour", "count")
    assert len(got) == 24 and got[0][0] == "14:00" and got[-1][0] == "13:00"
    assert [g for g in got if g[1]] == [("12:00", 3)]
    assert runs.congestion_total(runs.congestion_hours(log, NOW)).collect()[0].total == 3


def test_peaks_prefer_the_earlier_hour(run_rows):
    # 13:45 now: 18:00 and 02:00 are night hours of the last day, 04:00 and 11:00 morning hours.
    log = run_rows([{"run_at": hour(back), "records_upserted": n} for back, n in [(19, 5), (11, 5), (9, 4), (2, 6)]])
    congestion = runs.congestion_hours(log, NOW)
    assert sorted(pairs(runs.morning_night_peaks(congestion), "period", "hour", "count")) == [
        ("morning", "11:00", 6),
        ("night", "18:00", 5),
    ]
    assert pairs(runs.congestion_peak(congestion), "hour", "count") == [("11:00", 6)]
    bars = {row.hour: row for row in runs.congestion_bars(congestion).collect()}
    assert (bars["11:00"].height_pct, bars["18:00"].height_pct, bars["00:00"].height_pct) == (100, 83, 4)
    assert [h for h, row in sorted(bars.items()) if row.is_peak] == ["11:00", "18:00"]
    assert bars["06:00"].is_day and not bars["20:00"].is_day
    clock = {row.hour: row for row in runs.activity_clock(congestion, NOW).collect()}
    assert [h for h, row in clock.items() if row.is_now] == ["13:00"]
    assert [h for h, row in clock.items() if row.is_peak] == ["11:00"]


def test_no_peak_without_traffic(run_rows):
    congestion = runs.congestion_hours(run_rows([]), NOW)
    assert congestion.count() == 24
    assert runs.congestion_peak(congestion).count() == runs.morning_night_peaks(congestion).count() == 0


def test_run_metrics_count_missing_times_as_zero(run_rows):
    log = run_rows(
        [{"run_at": NOW - timedelta(minutes=m), "fetch_ms": 100, "upsert_ms": None, "records_upserted": m} for m in range(12)]
        + [{"run_at": NOW, "status": "error"}]
    )
    row = runs.run_metrics(log).collect()[0]
    assert (row.avg_fetch_ms, row.avg_upsert_ms, row.success_rate) == (100, 0, 90)
    assert (row.last_status, row.total_records, row.last_run_at) == ("error", None, NOW)
    assert tuple(runs.run_metrics(run_rows([])).collect()[0]) == (None,) * 6
    assert [r["id"] for r in runs.recent_runs(log, 3).collect()] == [12, 0, 1]


def test_records_today_is_null_for_zero(run_rows):
    midnight = datetime(2024, 5, 6)
    log = run_rows([
        {"run_at": midnight, "records_upserted": 5},
        {"run_at": midnight - timedelta(seconds=1), "records_upserted": 7},
        {"run_at": NOW, "records_upserted": None},
        {"run_at": NOW, "records_upserted": 9, "status": "error"},
    ])
    assert runs.records_today(log, NOW).collect()[0].records_today == 5
    assert runs.records_today(log.where("records_upserted IS NULL"), NOW).collect()[0].records_today is None
    assert runs.records_today(run_rows([]), NOW).collect()[0].records_today is None


@pytest.fixture
def hourly(spark):
    def build(rows):
        return spark.createDataFrame(rows, "hour_utc timestamp_ntz, ghost_count int, low_alt_count int")

    return build


def test_timeline_takes_the_later_row_of_an_hour(hourly):
    top = NOW.replace(minute=0, second=0)
    window = hourly([(top - timedelta(hours=24), 9, 9), (top, 1, 2), (top - timedelta(hours=1), 3, 0)])
    timeline = anomalies.anomaly_timeline(window)
    rows = {row.hour: tuple(row)[1:] for row in timeline.collect()}
    assert len(rows) == 24 and rows["13:00"] == (1, 2, 3) and rows["12:00"] == (3, 0, 3) and rows["00:00"] == (0, 0, 0)
    assert anomalies.anomaly_peak(timeline).collect()[0].hour == "12:00"


def test_alert_distribution(hourly):
    assert tuple(anomalies.alert_distribution(hourly([])).collect()[0]) == (0, 0, 0, 0, 100)
    assert tuple(anomalies.alert_distribution(hourly([(NOW, 1, 1)])).collect()[0]) == (1, 1, 50, 50, 0)
    row = anomalies.alert_distribution(hourly([(NOW, 1, 7)])).collect()[0]
    assert (row.ghost_pct, row.low_alt_pct, row.deviation_pct) == (13, 88, 0)


def test_rollup_overwrites_the_hour(live_rows, spark, ago):
    live = live_rows([
        {"ingested_at": ago(minutes=3), "geo_altitude": 500.0},
        {"ingested_at": ago(minutes=2), "geo_altitude": 500.0},
        {"geo_altitude": -5.0},
        {"on_ground": True, "ingested_at": ago(minutes=9)},
    ])
    rollup = anomalies.anomaly_hour_rollup(live, NOW)
    top = NOW.replace(minute=0, second=0)
    assert tuple(rollup.collect()[0]) == (top, 1, 2, NOW)
    stored = spark.createDataFrame([(top, 50, 50, ago(minutes=3)), (ago(hours=3), 4, 4, ago(hours=3))], rollup.schema)
    merged = anomalies.upsert_anomaly_hour(stored, rollup)
    assert sorted(pairs(merged, "ghost_count", "low_alt_count")) == [(1, 2), (4, 4)]


def test_history_counts_distinct_aircraft_per_hour(live_rows, ago):
    rows = live_rows([{"icao24": a, "ingested_at": ago(hours=h)} for a, h in [("x", 0), ("x", 0), ("y", 0), ("x", 1)]])
    assert sorted(pairs(anomalies.history_hourly(rows), "aircraft")) == [(1,), (2,)]


@pytest.mark.parametrize(
    "operator",
    [
        activity.airline_counts,
        activity.altitude_distribution,
        activity.country_activity,
        activity.country_speed,
        lambda live, by=(): activity.dashboard_stats(live, NOW, by=by),
        lambda live, by=(): activity.band_shares(activity.altitude_distribution(live, by), by),
        regions.region_counts,
        regions.region_scores,
        regions.longitude_density,
        lambda live, by=(): regions.density_levels(regions.longitude_density(live, by), by),
        regions.density_grid,
    ],
)
def test_by_equals_the_operator_on_each_group(live_rows, operator):
    def some(step):
        return live_rows([
            {
                "callsign": f"{prefix}{n}",
                "origin_country": f"C{n % 5}",
                "lat": float(n * step % 80),
                "lon": float(n * 7 * step % 360 - 180),
                "geo_altitude": n * 400.0 * step,
                "velocity": 100.0 + n * step,
                "on_ground": n % 11 == 0,
            }
            for n, prefix in enumerate(["BA", "EK", "ZZ", "AA"] * 10)
        ])

    parts = {1: some(1), 2: some(3)}
    both = parts[1].withColumn("cycle", F.lit(1)).unionByName(parts[2].withColumn("cycle", F.lit(2)))
    grouped = operator(both, by=["cycle"])
    for cycle, part in parts.items():
        alone = operator(part)
        got = grouped.where(F.col("cycle") == cycle).select(*alone.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_are_utc_in_any_session(spark, run_rows, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        log = run_rows([{"run_at": datetime(2024, 3, 10, 2, 30), "records_upserted": 5}])
        congestion = runs.congestion_hours(log, datetime(2024, 3, 10, 4, 10)).where("count > 0").collect()
        assert [(row.hs, row["count"]) for row in congestion] == [(datetime(2024, 3, 10, 2), 5)]
        history = log.selectExpr("run_at AS ingested_at", "'a' AS icao24", "false AS on_ground")
        assert [row.hs for row in anomalies.history_hourly(history).collect()] == [datetime(2024, 3, 10, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
