import math
import random

import pytest
from pyspark.sql import functions as F

from skywake.operators import nearest, positions, ranking


def evenly(rows, limit):
    if len(rows) <= limit:
        return rows
    return [rows[i * len(rows) // limit] for i in range(limit)]


@pytest.mark.parametrize(("n", "limit"), [(0, 5), (4, 5), (5, 5), (6, 5), (97, 10), (1000, 333), (1000, 999)])
def test_sample_takes_evenly_spaced_rows(spark, n, limit):
    keys = [f"{k:05d}" for k in random.Random(n).sample(range(100000), n)]
    rows = spark.createDataFrame([(k,) for k in keys], "icao24 string").repartition(5)
    got = sorted(row.icao24 for row in ranking.systematic_sample(rows, limit).collect())
    assert got == evenly(sorted(keys), limit)


def test_row_indexes_follow_key_order_with_a_crowded_first_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    indexed = ranking.row_indexes(rows, ["k", "id"]).orderBy("k", "id").collect()
    assert [row.row_index for row in indexed] == list(range(2000))


def test_zoom_changes_what_is_drawn(spark, live_rows):
    live = live_rows([{"lat": float(n % 90), "lon": float(n)} for n in range(50)])
    box = (10.0, 10.0, 20.0, 20.0)
    assert ranking.zoom_sample(live, 7, box).count() == positions.bbox_filter(live, *box).count() == 11
    assert ranking.zoom_sample(live, 3, box).count() == 50
    without = live.unionByName(live_rows([{"icao24": "nowhere"}]))
    assert ranking.zoom_sample(without, 3, box).count() == 50


def test_pages(spark):
    rows = spark.range(45).withColumnRenamed("id", "k").repartition(4)
    last = ranking.page_of(rows, ["k"], page=3).collect()
    assert [row.k for row in last] == [40, 41, 42, 43, 44]
    assert {(row.page, row.total_pages) for row in last} == {(3, 3)}
    assert ranking.page_of(rows, ["k"], page=4).count() == 0
    assert [row.k for row in ranking.page_after(rows, ["k"], [39]).collect()] == [40, 41, 42, 43, 44]
    assert [row.k for row in ranking.page_after(rows, ["k"], size=2).collect()] == [0, 1]
    pairs = rows.select((F.col("k") % 2).alias("a"), "k")
    assert [tuple(r) for r in ranking.page_after(pairs, ["a", "k"], [0, 42], 2).collect()] == [(0, 44), (1, 1)]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_over_a_key_with_nulls(spark, descending):
    given = [(k, None if k % 3 else f"c{k % 4}") for k in range(20)]
    rows = spark.createDataFrame(given, "k long, callsign string").repartition(3)
    order = [F.desc("callsign") if descending else F.asc("callsign"), "k"]
    expected = [tuple(r) for r in rows.orderBy(*order).select("callsign", "k").collect()]
    got, after = [], None
    while page := ranking.page_after(rows, [("callsign", descending), "k"], after, 3).select("callsign", "k").collect():
        got += [tuple(r) for r in page]
        after = list(page[-1])
    assert got == expected
    if not descending:
        pages = [ranking.page_of(rows, ["callsign", "k"], page=p, size=7).collect() for p in (1, 2, 3, 4)]
        assert [(r.callsign, r.k) for p in pages for r in p] == expected


def test_top_rows_by_group(spark):
    rows = spark.range(30).select((F.col("id") % 3).alias("g"), "id")
    got = ranking.top_rows(rows, [F.desc("id")], 2, ["g"]).collect()
    assert sorted(tuple(row) for row in got) == [(0, 24), (0, 27), (1, 25), (1, 28), (2, 26), (2, 29)]


def pixel(lat, lon, zoom):
    sine = math.sin(math.radians(max(min(lat, 85.0511287798), -85.0511287798)))
    size = 256 * 2**zoom
    return (lon + 180) / 360 * size, (0.5 - math.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * size


def brute_force(points, flights, zoom, radius=14):
    found = {}
    for number, lat, lon in points:
        px, py = pixel(lat, lon, zoom)
        reach = []
        for address, flat, flon in flights:
            if flat:
                x, y = pixel(flat, flon, zoom)
                distance = math.hypot(x - px, y - py)
                if distance < radius:
                    reach.append((distance, address))
        if reach:
            found[number] = min(reach)[1]
    return found


@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_nearest_equals_brute_force_with_a_crowded_place(spark, depth):
    rng = random.Random(7)
    spots = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(300)]
    spots += [(48 + rng.uniform(0, 0.2), 11 + rng.uniform(0, 0.2)) for _ in range(300)]  # a third in one cell
    spots += [(51.0, 7.0)] * 300 + [(0.0, 10.0)]
    flights = [(f"{n:06x}", lat, lon) for n, (lat, lon) in enumerate(spots)]
    points = [(n, rng.uniform(-80, 80), rng.uniform(-180, 180)) for n in range(100)]
    points += [(1000 + n, 48.1 + rng.uniform(-2, 2), 11.1 + rng.uniform(-2, 2)) for n in range(60)]
    points += [(2000, 51.0, 7.1), (2001, 0.0, 10.0)]
    got = nearest.nearest_aircraft(
        spark.createDataFrame(points, "point_id bigint, lat double, lon double"),
        spark.createDataFrame(flights, "icao24 string, lat double, lon double"),
        zoom=4,
        crowd=20,
        depth=depth,
    )
    assert {row.point_id: row.icao24 for row in got.collect()} == brute_force(points, flights, 4)
    assert "SortAggregate" not in spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")


def test_depth_grows_only_where_cells_are_crowded(spark):
    sparse = spark.range(50).select(F.col("id").cast("string").alias("icao24"), (F.col("id") * 50.0).alias("x"), F.lit(1.0).alias("y"))
    assert nearest._needed_depth(sparse, 14, 10) == 0
    dense = sparse.withColumn("x", F.col("x") / 1000)
    assert nearest._needed_depth(dense, 14, 10) > 0
    assert nearest._needed_depth(sparse.withColumn("x", F.col("x") / 1e8), 14, 10) > nearest.DEPTHS
    assert nearest._needed_depth(sparse.limit(0), 14, 10) == 0


def test_profile_of_one_and_of_all(spark, live_rows, ago):
    rows = live_rows(
        [{"icao24": "a", "geo_altitude": 100.0, "ingested_at": ago(minutes=m)} for m in range(70)]
        + [{"icao24": "b", "geo_altitude": 0.0, "baro_altitude": 10.0}, {"icao24": "c"}]
    )
    one = positions.altitude_profile(rows, ["ingested_at"], "a").orderBy("point").collect()
    assert len(one) == 60 and one[0].time == "12:36" and one[0].alt == 328
    everything = positions.altitude_profile(rows, ["ingested_at"])
    assert everything.count() == 62
    assert {r.icao24: r.alt for r in everything.where("icao24 <> 'a'").collect()} == {"b": 33, "c": 0}


def test_scatter_limits(live_rows):
    live = live_rows([
        {"velocity": 200.0, "geo_altitude": 5000.0},
        {"velocity": 400.0, "geo_altitude": 5000.0},
        {"velocity": 200.0, "geo_altitude": 17000.0, "lat": 1.0, "lon": 1.0},
        {"velocity": 0.2, "geo_altitude": 5000.0},
        {"velocity": 200.0, "geo_altitude": 0.0},
    ])
    assert [r.icao24 for r in positions.performance_scatter(live).collect()] == ["a00000"]
    wide = positions.performance_scatter(live, wide=True).collect()
    assert [(r.icao24, r.band) for r in wide] == [("a00002", "high")]


def test_client_limit_of_positions(live_rows):
    live = live_rows([{"lat": 1.0, "lon": 1.0}] * 5 + [{}])
    assert positions.scan_live_positions(live).count() == 5
    assert [r.icao24 for r in positions.scan_live_positions(live, 2).collect()] == ["a00000", "a00001"]


def test_the_scatter_shows_all_eligible_aircraft(spark):
    live = spark.range(3000).selectExpr(
        "format_string('%06x', id) AS icao24", "'BA1' AS callsign", "'Spain' AS origin_country", "1.0D AS lon", "1.0D AS lat", "200.0D AS velocity",
        "9000.0D AS geo_altitude", "false AS on_ground",
    )
    assert positions.performance_scatter(live).count() == positions.performance_scatter(live, wide=True).count() == 3000
    assert positions.performance_scatter(live, limit=2000).count() == 2000


def test_a_point_knows_its_reach_before_it_meets_cells(spark):
    """Dense aircraft: the reach lies between the distance of the nearest and the width of a fine cell, so few pairs are left to move."""
    spots = spark.range(10000).selectExpr("CAST(id % 100 AS DOUBLE) + 0.25D AS x", "CAST(id div 100 AS DOUBLE) + 0.25D AS y", "CAST(id AS STRING) AS icao24")
    asked = spark.createDataFrame([(1, 50.0, 50.0), (1, 20.3, 70.0), (2, 5000.0, 50.0)], "point_id bigint, px double, py double")
    for depth in (0, 1, 2):
        reach = {(r.point_id, r.px): r.reach for r in nearest._reached(asked, spots, 16.0, depth).collect()}
        assert reach[2, 5000.0] == 16.0
        assert 0.35 < reach[1, 50.0] <= min(16.0, 16 / 4**depth * 2**0.5)
    cells = {"cx": F.floor(F.col("px") / 16), "cy": F.floor(F.col("py") / 16)}
    pairs = nearest._reached(asked.where("px < 100"), spots, 16.0, 2).withColumns(cells)
    assert nearest._narrow(pairs, spots, 16.0, 1).count() <= 8


def test_aircraft_at_one_pixel_beyond_the_projection_are_one(spark):
    flights = spark.range(3000).selectExpr("lpad(hex(id), 6, '0') AS icao24", "86D + id / 1000D AS lat", "10D AS lon")
    points = spark.createDataFrame([(5, 89.0, 10.0), (None, 89.0, 10.0), (6, 40.0, 10.0)], "point_id bigint, lat double, lon double")
    got = nearest.nearest_aircraft(points, flights, zoom=3, crowd=8).collect()
    assert [(r.point_id, r.icao24, r.distance_px) for r in got] == [(5, "000000", 0.0)]
