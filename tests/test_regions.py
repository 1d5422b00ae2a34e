"""Regions from a table against a comparison of every pair; the order on the Z curve."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skywake.functions import geo
from skywake.operators import regions

BOX = "region long, south double, west double, north double, east double"


def _boxes(rng, count):
    for k in range(count):
        size = rng.choice([0.0, 0.01, 0.5, 5.0, 60.0, 400.0])
        south, west = rng.uniform(-95, 90), rng.uniform(-190, 180)
        yield (k, south, west, south + size * rng.random(), west + size * rng.random() * rng.choice([1, 1, 30]))


def _expected(live, boxes):
    found = []
    for region, south, west, north, east in {b for b in boxes}:
        if None in (south, west, north, east):
            continue
        found += [(region, a["icao24"]) for a in live if not a["on_ground"] and a["lat"] is not None and a["lon"] is not None
                  and south <= a["lat"] <= north and west <= a["lon"] <= east]
    return sorted(found)


def test_a_table_of_regions_equals_every_pair(spark, live_rows):
    rng = random.Random(5)
    crowd = [{"lat": 50.0, "lon": 8.0} for _ in range(120)]  # a third at one place
    live = crowd + [{"lat": rng.uniform(-90, 90), "lon": rng.choice([180.0, -180.0, rng.uniform(-180, 180)])} for _ in range(200)]
    live += [{"lat": None, "lon": 3.0}, {"lat": 1.0, "lon": None}, {"lat": 50.0, "lon": 8.0, "on_ground": True}, {"lat": math.nan, "lon": 0.0}]
    for n, row in enumerate(live):
        row.setdefault("on_ground", False)
        row["icao24"] = f"{n:05d}"
    boxes = list(_boxes(rng, 300)) + [(900, 50.0, 8.0, 50.0, 8.0), (901, -90.0, -180.0, 90.0, 180.0), (902, 10.0, 170.0, 20.0, -170.0), (903, None, 0.0, 1.0, 1.0)]
    boxes += [(904, 60.0, 0.0, 10.0, 20.0), (905, -math.inf, -math.inf, math.inf, math.inf), (1, *boxes[1][1:])]
    table, rows = spark.createDataFrame(boxes, BOX), live_rows(live)
    expected = _expected(live, boxes)
    held = regions.region_table_membership(rows, table)
    assert held.columns == ["region", *rows.columns]
    assert sorted((r.region, r.icao24) for r in held.collect()) == expected
    counts = {r.region: r.flight_count for r in regions.region_table_traffic(rows, table).collect()}
    assert counts == {b[0]: sum(e[0] == b[0] for e in expected) for b in boxes}
    assert regions.region_table_membership(rows, table.limit(0)).count() == 0
    assert {r.flight_count for r in regions.region_table_traffic(rows.limit(0), table).collect()} == {0}


def test_many_regions_meet_by_cells_alone(spark, live_rows):
    rng = random.Random(6)
    table = spark.range(100_000).select(
        F.col("id").alias("region"), (F.rand(1) * 170 - 90).alias("south"), (F.rand(2) * 350 - 180).alias("west"), F.pow(F.lit(2.0), F.floor(F.rand(3) * 14) - 9).alias("size")
    )
    table = table.select("region", "south", "west", (F.col("south") + F.col("size")).alias("north"), (F.col("west") + F.col("size") * 2).alias("east"))
    cells = regions.covered(table)
    assert cells.groupBy("region").count().agg(F.max("count")).first()[0] <= regions.MOST_CELLS
    assert cells.select("level").distinct().count() > 8
    live = live_rows([{"lat": rng.uniform(-90, 90), "lon": rng.uniform(-180, 180)} for _ in range(50)])
    joined = regions.region_table_membership(live, table)
    plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    boxes = [tuple(r) for r in table.collect()]
    expected = sum(s <= a.lat <= n and w <= a.lon <= e for a in live.collect() for _, s, w, n, e in boxes)
    assert joined.count() == expected > 1000
    assert regions.region_table_traffic(live, table).agg(F.sum("flight_count")).first()[0] == expected


def _place(lat, lon, bits):
    x, y = math.floor((lon + 180) / 360 * (2**bits - 1)), math.floor((lat + 90) / 180 * (2**bits - 1))
    return sum((x >> k & 1) << 2 * k + 1 | (y >> k & 1) << 2 * k for k in range(bits))


def test_the_z_curve_takes_bits_in_turn(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", geo.z_order(F.col("lat"), F.col("lon")).alias("z"))
    assert all(r.z == _place(r.lat, r.lon, 16) for r in rows.collect())


@pytest.mark.parametrize("seed", range(8))
def test_stretches_of_the_curve_cover_a_box(seed):
    rng = random.Random(seed)
    south, west = rng.uniform(-90, 80), rng.uniform(-180, 160)
    box = (south, west, south + rng.uniform(0, 30), west + rng.uniform(0, 60))
    ranges = geo.z_ranges(*box)
    assert 0 < len(ranges) <= 32 and all(a <= b for a, b in ranges) and all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    inside = [(rng.uniform(box[0], min(90, box[2])), rng.uniform(box[1], min(180, box[3]))) for _ in range(300)]
    assert all(any(a <= _place(lat, lon, 16) <= b for a, b in ranges) for lat, lon in inside)
    covered = sum(b - a + 1 for a, b in ranges) / 4**16
    area = (min(90, box[2]) - south) / 180 * (min(180, box[3]) - west) / 360
    assert covered < 3 * area + 0.01
    assert geo.z_ranges(10, 20, 5, 30) == []


def test_counts_of_a_table_equal_brute_force_with_one_row_a_box_and_strip(spark, live_rows, monkeypatch):
    """Boxes and places in several strips and groups; a box travels once to each strip it touches, not once a cell."""
    rng = random.Random(5)
    monkeypatch.setattr(regions, "STRIPS", 5)
    monkeypatch.setattr(regions, "BOXES", 60)
    spots = [(float(rng.randint(-20, 20)), float(rng.choice([*range(-40, 40), 7, 7, 7]))) for _ in range(400)]
    live = live_rows([{"lat": lat, "lon": lon} for lat, lon in spots])
    boxes = [(n % 290, *(float(v) for v in (s, w, s + rng.randint(-1, 9), w + rng.randint(-1, 60)))) for n in range(300) for s, w in [(rng.randint(-25, 20), rng.randint(-45, 40))]]
    boxes += [boxes[7], (400, None, 0.0, 1.0, 1.0), (401, 0.0, 0.0, float("inf"), float("nan")), (None, 0.0, 0.0, 9.0, 9.0)]
    table = spark.createDataFrame(boxes, "region bigint, south double, west double, north double, east double")
    want: dict = {box[0]: 0 for box in boxes}
    for region, south, west, north, east in set(boxes[:300]):
        want[region] += sum(south <= lat <= north and west <= lon <= east for lat, lon in spots)
    want[401] = sum(lat >= 0 and lon >= 0 for lat, lon in spots)
    got = regions.region_table_traffic(live, table)
    assert {r.region: r.flight_count for r in got.collect()} == want
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "FlatMapCoGroupsInArrow" in plan and "cx" not in plan


def test_a_box_meets_aircraft_in_few_cells(spark, live_rows, monkeypatch):
    rng = random.Random(8)
    boxes = list(_boxes(rng, 200))
    live = [{"lat": rng.uniform(-90, 90), "lon": rng.uniform(-180, 180), "icao24": f"{n:05d}", "on_ground": False} for n in range(100)]
    found, covered = [], regions.covered
    monkeypatch.setattr(regions, "covered", lambda *a: found.append(covered(*a)) or found[-1])
    held = regions.region_table_membership(live_rows(live), spark.createDataFrame(boxes, BOX))
    assert sorted((r.region, r.icao24) for r in held.collect()) == _expected(live, boxes)
    assert found[0].groupBy("region").count().agg(F.max("count")).first()[0] <= 9
