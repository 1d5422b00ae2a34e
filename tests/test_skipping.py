"""Lookups in stored tables read the row groups they need; sketches of parts make the sketch of the whole."""

import random
from datetime import timedelta

import pytest
from fixed_time import NOW
from pyspark.sql import functions as F

from skywake.operators import anomalies, positions
from skywake.schemas import LIVE, SKETCHES
from skywake.sources.tables import BatchLog, in_view, read_history, write_by_place, write_history

GROUP = 16 << 10


def rows_read(frame):
    """Rows that the scans of a query hand on, after row groups and pages were skipped."""
    frame.collect()

    def scanned(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scanned(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scanned(plan.plan())
        if kind == "FileSourceScanExec":
            return plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        return sum(scanned(children.apply(k)) for k in range(children.size()))

    return scanned(frame._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def log(spark):
    """Six hours of 4,000 aircraft, a third of all rows of one."""
    numbered = spark.range(36_000).withColumn("n", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.hash("id"), F.lit(4_000))))
    fields = {
        "icao24": F.lower(F.hex(F.col("n") + 1_048_576)),
        "lat": F.rand(1) * 180 - 90,
        "lon": F.rand(2) * 360 - 180,
        "on_ground": F.lit(False),
        "geo_altitude": (F.col("id") % 9000).cast("double"),
        "ingested_at": F.lit(NOW) + F.make_dt_interval(mins=F.floor(F.col("id") / 100), secs=(F.col("id") % 60).cast("decimal(8,6)")),
    }
    return numbered.select(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LIVE)).checkpoint()


def test_one_aircraft_is_looked_up_by_hour_and_address(spark, log, tmp_path):
    path = str(tmp_path / "history")
    for batch, part in enumerate(log.randomSplit([1.0, 1.0], 3)):
        write_history(part, batch, path, GROUP)
    stored = read_history(spark, path)
    assert stored.count() == 36_000
    some = lambda frame, address: positions.altitude_profile(frame, ["ingested_at", "lon"], address, 10_000)
    rare, absent, crowded = "1003e9", "1fffff", "100007"
    for address in (rare, crowded):
        expected = some(log, address).collect()
        assert some(stored, address).orderBy("point").collect() == sorted(expected, key=lambda r: r.point) and expected
    assert rows_read(some(stored, rare)) < 36_000 / 8
    assert rows_read(some(stored, absent)) < 36_000 / 8
    late = stored.where(F.col("ingest_hour") >= F.lit(NOW + timedelta(hours=4)))
    assert rows_read(some(late, rare)) < rows_read(some(stored, rare))
    assert rows_read(some(late, crowded)) < rows_read(some(stored, crowded)) / 2


def test_a_view_reads_its_part_of_the_curve(spark, log, tmp_path):
    path = str(tmp_path / "places")
    write_by_place(log, path, GROUP)
    stored = spark.read.parquet(path)
    rng = random.Random(4)
    for height, width, share in ((4, 8, 0.1), (20, 40, 0.2), (180, 360, 1.0), (0, 0, 0.1)):
        south, west = rng.uniform(-90, 90 - height), rng.uniform(-180, 180 - width)
        view = (south, west, south + height, west + width)
        found = in_view(stored, *view)
        assert sorted(found.collect(), key=str) == sorted(positions.bbox_filter(log, *view).collect(), key=str)
        assert rows_read(found) <= max(36_000 * share, 1)
    assert in_view(stored, 10.0, 170.0, 20.0, -170.0).count() == 0  # over the date line: two boxes
    assert in_view(stored, -999.0, -999.0, 999.0, 999.0).count() == 36_000


def test_sketches_of_parts_are_merged(spark, log, tmp_path):
    exact = {r.hs: r.aircraft for r in anomalies.history_hourly(log).collect()}
    sketches = BatchLog(spark, str(tmp_path / "sketches"), SKETCHES)
    for batch, part in enumerate(log.randomSplit([1.0] * 4, 5)):
        sketches.write(batch, anomalies.hourly_sketches(part))
    sketches.write(2, sketches.of(2))  # a batch that is written again
    merged = {r.hs: r.aircraft for r in anomalies.merged_hourly(sketches.read()).collect()}
    assert merged.keys() == exact.keys() and len(exact) >= 6
    assert all(abs(merged[h] - n) <= n * anomalies.SKETCH_ERROR for h, n in exact.items())
    whole = {r.hs: r.aircraft for r in anomalies.merged_hourly(anomalies.hourly_sketches(log)).collect()}
    assert all(abs(whole[h] - merged[h]) <= n * anomalies.SKETCH_ERROR for h, n in exact.items())
    days = anomalies.merged_hourly(sketches.read(), 24).collect()
    aircraft = log.groupBy(F.floor(F.unix_seconds(F.col("ingested_at").cast("timestamp")) / 86400)).agg(F.countDistinct("icao24").alias("n"))
    assert all(min(abs(d.aircraft - r.n) / r.n for r in aircraft.collect()) <= anomalies.SKETCH_ERROR for d in days)
