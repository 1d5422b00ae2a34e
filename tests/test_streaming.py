"""Cycles over landing files: result equal to the batch form, replays, empty and failing batches, signals in any order."""

import json
import os
import random
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skywake.operators import activity, anomalies, maintenance, runs as run_log
from skywake.schemas import LIVE, SNAPSHOT
from skywake.sources.snapshots import explode_snapshots, parse_states
from skywake.sources.tables import Store, read_history, write_history
from skywake.streaming import ingest, signals

START = 1_700_000_000
BUCKETS = 4


def vector(address, altitude=10000.0, ground=False, lat=50.0, lon=8.0, callsign="BA1 "):
    return [address, callsign, "Spain", None, None, lon, lat, 900.0, ground, 200.0, 90.0, 0.0, None, altitude]


def land(folder, number, states, time=None):
    """Write the snapshot of a cycle; the stream takes files by age."""
    path = folder / f"cycle-{number:03d}.json"
    path.write_text(json.dumps({"time": START + number * 180 if time is None else time, "states": states}))
    os.utime(path, (START + number * 180, START + number * 180))


def vectors_of(spark, path):
    """The vectors of one landed file, read as a batch."""
    return explode_snapshots(spark.read.schema(SNAPSHOT).json(str(path)), keep_empty=True).withColumn("file", F.xxhash64("file"))


def utc(number):
    return datetime.fromtimestamp(START + number * 180, timezone.utc).replace(tzinfo=None)


@pytest.fixture
def job(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")

    def run():
        ingest.start_ingest(spark, str(landing), root, checkpoint, max_files=1, buckets=BUCKETS).awaitTermination()
        return Store(spark, root, BUCKETS)

    return landing, run


@pytest.fixture
def follow(spark, tmp_path):
    """Ingest a folder with so many files a batch, and give the store and the signals behind it."""

    def run(landing, name, files=None, followed=None, lateness=timedelta(0)):
        store = Store(spark, str(tmp_path / name), BUCKETS)
        ingest.start_ingest(spark, str(landing), store.root, f"{store.root}-offsets", max_files=files, buckets=BUCKETS).awaitTermination()
        query = signals.start_signals(spark, store, f"{store.root}-signals", max_files=followed, buckets=BUCKETS, lateness=lateness)
        query.awaitTermination()
        return store, query

    return run


def rows(frame, *names):
    return sorted(tuple(row[n] for n in names) for row in frame.collect())


def contents(store):
    held = {"live": store.live.current(), "runs": store.run_log(), "hourly": signals.hourly(store), "alerts": signals.alerts(store)}
    return {t: sorted((tuple(row[c] for c in f.columns if not c.endswith("_ms")) for row in f.collect()), key=str) for t, f in held.items()}


def expected_signals(snapshots):
    """Alerts (cycle, address) and the hour's last counts (hour, ghosts, low) by the rule of the run log; `snapshots` has each time's vectors, or none."""
    alerts, hours, before = [], {}, set()
    latest = {}
    for time in sorted(snapshots):
        good = bool(snapshots[time])
        for v in snapshots[time] or []:
            latest[v[0].lower()] = (time, v)
        success = max((t for t in snapshots if t <= time and snapshots[t]), default=None)
        seen = {a: (t, v) for a, (t, v) in latest.items() if time - t <= 1800}
        lost = {a for a, (t, v) in seen.items() if success is not None and not v[8] and t < success - 30 and time - t <= 900}
        alerts += [(utc_of(time), a) for a in lost - before]
        before = lost
        if good:
            ghosts = sum(not v[8] and t < time - 120 for t, v in seen.values())
            low = sum(not v[8] and 0 < v[13] * 3.28084 < 3000 for t, v in seen.values())
            hours[time // 3600] = (utc_of(time // 3600 * 3600), ghosts, low, utc_of(time))
    return sorted(alerts), sorted(hours.values())


def utc_of(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def test_cycles_upsert_purge_and_log(job):
    landing, run = job
    land(landing, 0, [vector("A", 500.0), vector("B"), vector("C", ground=True)])
    land(landing, 1, [vector("a"), vector("d", lat=None)])
    store = run()
    assert rows(store.live.current(), "icao24", "geo_altitude", "ingested_at") == [
        ("a", 10000.0, utc(1)),
        ("b", 10000.0, utc(0)),
        ("c", 10000.0, utc(0)),
    ]
    assert rows(store.run_log(), "run_at", "records_fetched", "status") == [(utc(0), 3, "success"), (utc(1), 1, "success")]
    land(landing, 12, [vector("a")])
    assert rows(run().live.current(), "icao24") == [("a",)]


def test_runs_carry_measured_times(job):
    landing, run = job
    land(landing, 0, [vector("a"), vector("b")])
    land(landing, 1, None)
    log = run().run_log()
    (first, second) = log.orderBy("run_at").collect()
    assert first.fetch_ms > 0 and first.upsert_ms > 0 and first.status == "success"
    assert second.fetch_ms > 0 and second.upsert_ms == 0 and second.status == "error"
    figures = run_log.run_metrics(log).first()
    assert (figures.avg_fetch_ms, figures.avg_upsert_ms) == (first.fetch_ms, first.upsert_ms)
    assert (figures.total_records, figures.success_rate, figures.last_status) == (0, 50, "error")


def test_an_empty_snapshot_is_logged_and_changes_nothing(job):
    landing, run = job
    land(landing, 0, [vector("a")])
    land(landing, 1, None)
    land(landing, 2, [vector("b", lat=None)])
    store = run()
    assert rows(store.live.current(), "icao24", "ingested_at") == [("a", utc(0))]
    log = rows(store.run_log(), "run_at", "records_upserted", "status")
    assert log == [(utc(0), 1, "success"), (utc(1), 0, "error"), (utc(2), 0, "error")]


def test_a_replayed_batch_changes_nothing(spark, job):
    landing, run = job
    land(landing, 0, [vector("a"), vector("b")])
    land(landing, 1, [vector("a", callsign=None)])
    store = run()
    tables = lambda: [rows(f, *(c for c in f.columns if not c.endswith("_ms"))) for f in (store.live.current(), store.run_log())]
    counts = lambda: sorted(map(tuple, store.current_counts().collect()), key=str)
    before, counted = tables(), counts()
    ingest.run_cycle(vectors_of(spark, landing / "cycle-001.json"), 1, store)
    assert (tables(), counts()) == (before, counted) and store.counts.batches() == [0, 1]


def _files(store):
    found = {}
    for folder, _, names in os.walk(store.live.path):
        if "slot=" in folder:
            found[int(folder.rpartition("slot=")[2])] = {n for n in names if n.endswith(".parquet")}
    return found


def test_an_upsert_touches_its_buckets_alone_and_moves_the_batch_alone(spark, job):
    landing, run = job
    land(landing, 0, [vector(f"{n:03x}") for n in range(60)])
    store = run()
    before = _files(store)
    assert set(before) == set(range(BUCKETS)) and all(len(names) == 1 for names in before.values())
    slot = spark.createDataFrame([("005",)], "icao24 string").select(store.live.slot()).first()[0]
    land(landing, 1, [vector("005", 1234.0)])
    store = run()
    after = _files(store)
    assert after[slot] != before[slot] and all(after[s] == before[s] for s in before if s != slot)
    assert rows(store.live.current().where("geo_altitude = 1234"), "icao24") == [("005",)] and store.live.current().count() == 60
    batch = store.live.current().limit(0).withColumn("x", F.lit(1))
    merged = store.live.merged(store.live.current().withColumn("x", F.rand()), [F.desc("x")])
    plan = spark._jvm.PythonSQLUtils.explainString(merged._jdf.queryExecution(), "simple")
    base = plan[plan.index("SortMergeJoin") :].split("\n")
    # the stored side comes first and reaches the scan without an exchange
    stored = base[: next(k for k, line in enumerate(base) if "FileScan" in line) + 1]
    assert "Bucketed: true" in stored[-1] and not any("Exchange" in line for line in stored)
    assert batch.count() == 0


def test_a_late_snapshot_does_not_turn_time_back(job):
    landing, run = job
    land(landing, 5, [vector("a", 8000.0)])
    land(landing, 6, [vector("a", 1.0), vector("late")], time=START)
    store = run()
    assert rows(store.live.current(), "icao24", "geo_altitude", "ingested_at") == [
        ("a", 8000.0, utc(5)),
        ("late", 10000.0, utc(0)),
    ]
    assert {row.run_at for row in store.run_log().collect()} == {utc(0), utc(5)}


def test_of_snapshots_with_one_time_the_last_landed_counts(spark, job, tmp_path):
    landing, _ = job
    land(landing, 2, [vector("a", 1000.0), vector("a", 2000.0)], time=START)
    land(landing, 1, [vector("a", 3000.0), vector("b")], time=START)
    root = str(tmp_path / "one")
    ingest.start_ingest(spark, str(landing), root, str(tmp_path / "one-checkpoint")).awaitTermination()
    assert rows(Store(spark, root).live.current(), "icao24", "geo_altitude") == [("a", 2000.0), ("b", 10000.0)]


def test_a_failure_is_logged_and_what_was_stored_stays(spark, job, monkeypatch):
    landing, run = job
    land(landing, 0, [vector("a")])
    store = run()

    def broken(*args):
        raise RuntimeError("disk full")

    land(landing, 1, [vector("b")])
    with monkeypatch.context() as patch:
        patch.setattr(ingest, "counts_before", broken)
        for _ in range(2):  # one row a batch, however often it fails
            with pytest.raises(RuntimeError):
                ingest.run_cycle(vectors_of(spark, landing / "cycle-001.json"), 1, store)
    assert rows(store.live.current(), "icao24") == [("a",)]
    assert rows(store.run_log(), "status", "error_msg") == [("error", "disk full"), ("success", None)]
    with monkeypatch.context() as patch:  # the counts are there, the rows are not
        patch.setattr(ingest, "cycle_runs", broken)
        patch.setattr(type(store.live), "store", broken)
        with pytest.raises(RuntimeError):
            ingest.run_cycle(vectors_of(spark, landing / "cycle-001.json"), 1, store)
    assert store.counts.batches() == [0, 1] and rows(store.live.current(), "icao24") == [("a",)]
    ingest.run_cycle(vectors_of(spark, landing / "cycle-001.json"), 1, store)
    assert rows(store.live.current(), "icao24") == [("a",), ("b",)]
    assert rows(maintenance.altitude_distribution(store.current_counts(), utc(1)), "flight_count") == [(2,)]


def test_batches_past_retention_go(spark, job):
    landing, run = job
    land(landing, 0, [vector("a")])
    store = run()
    store.failures.write(0, ingest.failed_run(spark, utc(0) - timedelta(days=4), 77, 1, "old"))
    store.failures.write(1, ingest.failed_run(spark, utc(0), 78, 1, "new"))
    land(landing, 1, [vector("a")])
    assert rows(run().run_log().where("status = 'error'"), "id") == [(78,)]
    land(landing, 3 * 480 + 10, [vector("a")])  # three days later
    store = run()
    assert store.runs.batches() == [2] and store.observed.batches() == [2] and store.counts.batches() == [1, 2]
    assert store.run_log().count() == 1


def test_counts_follow_the_changes(spark, job):
    """Views from the kept counts equal the views over the live table after every batch, upserts and expiry included."""
    landing, run = job
    rng = random.Random(4)
    for number in (0, 1, 2, 3, 8, 12, 13, 25):
        seen = [
            vector(f"{n:02x}", rng.choice([None, 0.0, 500.0, 3000.0, 12000.0]), rng.random() < 0.3, callsign=rng.choice([None, "BA1 ", "RYR2", "zzz"]))
            for n in range(40)
            if rng.random() < 0.5
        ]
        for v in seen:
            v[2] = rng.choice([None, "Spain", "Peru", "Chad"])
        land(landing, number, seen)
        store = run()
        live, counts, as_of = store.live.current(), store.current_counts(), utc(number)
        for name in ("airline_activity", "altitude_distribution", "country_activity"):
            kept, whole = getattr(maintenance, name)(counts, as_of), getattr(activity, name)(live)
            assert kept.columns == whole.columns and rows(kept, *kept.columns) == rows(whole, *whole.columns)
        kept, whole = maintenance.dashboard_stats(counts, as_of), activity.dashboard_stats(live, as_of)
        assert kept.collect() == whole.select(kept.columns).collect()
        assert counts.where("n <= 0").count() == 0


def test_only_changed_rows_are_counted(spark):
    row = "struct<icao24: string, callsign: string, origin_country: string, lon: double, lat: double, baro_altitude: double, geo_altitude: double, on_ground: boolean, velocity: double, true_track: double, vertical_rate: double, ingested_at: timestamp_ntz>"
    one = ("a", "BA1", "Spain", 1.0, 1.0, 1.0, 1.0, False, 1.0, 1.0, 1.0, utc(0))
    same = spark.createDataFrame([("a", one, one), ("b", None, None)], f"icao24 string, old {row}, new {row}")
    assert maintenance.deltas(same).count() == 0
    gone = spark.createDataFrame([("a", one, None)], f"icao24 string, old {row}, new {row}")
    assert {r.n for r in maintenance.deltas(gone).collect()} == {-1}


def test_signals_are_those_of_the_batch_rule(job, follow):
    landing, _ = job
    land(landing, 0, [vector("A", 500.0), vector("B"), vector("C", ground=True)])
    land(landing, 1, [vector("a"), vector("d", lat=None)])
    land(landing, 2, [vector("a")])
    land(landing, 3, None)
    store, _ = follow(landing, "signals")
    assert rows(signals.alerts(store), "cycle", "icao24", "message") == [(utc(1), "b", "BA1 transponder signal lost")]
    assert rows(signals.hourly(store), "ghost_count", "low_alt_count", "updated_at") == [(1, 0, utc(2))]


def test_the_hour_equals_the_batch_rollup(job, follow):
    landing, _ = job
    for cycle in range(4):
        land(landing, cycle, [vector(f"{n:03x}", 100.0 * n) for n in range(0, 40, cycle + 1)])
    store, _ = follow(landing, "rollup")
    rollup = anomalies.anomaly_hour_rollup(store.live.current(), utc(3))
    assert rows(signals.hourly(store), *rollup.columns) == rows(rollup, *rollup.columns)


def _feed(rng, numbers):
    """Snapshots by time, some of them empty, with aircraft that come and go."""
    held = {}
    for number in numbers:
        seen = [vector(f"{n:02x}", 100.0 * n, ground=n % 5 == 0) for n in range(14) if rng.random() < 0.75 or number % 7 == n % 7]
        held[START + number * 180 - (number % 3) * 40] = None if rng.random() < 0.15 else seen
    return held


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_do_not_depend_on_order_or_size_of_batches(tmp_path, follow, seed):
    rng = random.Random(seed)
    feed = _feed(rng, [n for n in range(60) if n % 20 < 8])
    end = max(feed) + 4 * 3600  # a later snapshot without vectors moves the clock
    alerts, hours = expected_signals(feed)
    assert len(alerts) > 8 and len(hours) >= 3

    def landed(name, times):
        folder = tmp_path / name
        folder.mkdir()
        for place, time in enumerate([*times, end]):
            path = folder / f"f{place:03d}.json"
            path.write_text(json.dumps({"time": time, "states": feed.get(time)}))
            os.utime(path, (end + place, end + place))
        return folder

    times = sorted(feed)
    mixed = times[:]
    rng.shuffle(mixed)
    span = timedelta(seconds=times[-1] - times[0] + 1)
    found = []
    for name, order, files, followed, late in (("whole", times, None, None, timedelta(0)), ("fives", times, 5, 2, span), ("mixed", mixed, 6, 1, span)):
        store, query = follow(landed(f"{name}-landing", order), name, files, followed, late)
        assert signals.late_rows(query) == 0
        found.append(contents(store))
        assert rows(signals.alerts(store), "cycle", "icao24") == alerts
        assert rows(signals.hourly(store), "hour_utc", "ghost_count", "low_alt_count", "updated_at") == hours
    assert found[0] == found[1] == found[2]


def test_signals_go_on_from_their_checkpoint(job, follow):
    landing, _ = job
    feed = _feed(random.Random(9), range(12))
    alerts, hours = expected_signals(feed)
    for number, time in enumerate([*sorted(feed), max(feed) + 7200]):
        land(landing, number, feed.get(time), time)
        store, _ = follow(landing, "restarted")  # both streams end and start again after every file
    assert rows(signals.alerts(store), "cycle", "icao24") == alerts
    assert rows(signals.hourly(store), "hour_utc", "ghost_count", "low_alt_count", "updated_at") == hours


def test_vectors_behind_the_watermark_are_counted(job, follow):
    landing, _ = job
    land(landing, 10, [vector("a")])
    land(landing, 11, [vector("a")])
    land(landing, 12, [vector("x"), vector("y")], time=START)
    land(landing, 20, None)
    store, query = follow(landing, "late", files=1, followed=1, lateness=timedelta(minutes=5))
    assert signals.late_rows(query) >= 2
    assert rows(signals.alerts(store), "icao24") == []
    assert rows(store.live.current(), "icao24") == [("a",)]  # past retention


@pytest.mark.parametrize("valid", [True, False])
def test_a_snapshot_dated_ahead_is_rejected(spark, job, follow, tmp_path, valid):
    landing, run = job
    years = START + 10 * 365 * 86400
    land(landing, 0, [vector("x", lat=50.0 if valid else None)], time=years)
    land(landing, 1, [vector("a")])
    land(landing, 2, [vector("a"), vector("b")])
    store = run()
    assert rows(store.live.current(), "icao24", "ingested_at") == [("a", utc(2)), ("b", utc(2))]
    assert rows(store.run_log(), "run_at", "status") == [(utc(0), "error"), (utc(1), "success"), (utc(2), "success")]
    land(landing, 4, [vector("a")])
    store, query = follow(landing, "ahead", files=1, followed=1)
    assert signals.late_rows(query) == 0
    path = str(tmp_path / "log")
    ingest.start_history(spark, str(landing), path, str(tmp_path / "log-offsets"), max_files=1).awaitTermination()
    land(landing, 5, [vector("x", lat=50.0 if valid else None)], time=years)
    ingest.start_history(spark, str(landing), path, str(tmp_path / "log-offsets"), max_files=1).awaitTermination()
    assert rows(read_history(spark, path), "icao24", "ingested_at") == [("a", utc(1)), ("a", utc(2)), ("a", utc(4)), ("b", utc(2))]


def test_a_snapshot_dated_ahead_hides_no_cycle_of_a_backlog(tmp_path, follow):
    feed = _feed(random.Random(3), [n for n in range(60) if n % 20 < 3])
    alerts, hours = expected_signals(feed)
    landing = tmp_path / "backlog"
    landing.mkdir()
    times = sorted(feed)
    end = times[-1] + 7200
    for place, time in enumerate([*times[:2], START + 10 * 365 * 86400, *times[2:], end]):
        path = landing / f"file-{place:03d}.json"
        path.write_text(json.dumps({"time": time, "states": feed.get(time, [vector("zz")] if time > end else None)}))
        os.utime(path, (end + place, end + place))  # all land behind the last cycle
    found = []
    for name, files in (("whole", None), ("fives", 5), ("ones", 1)):
        store, _ = follow(landing, name, files, files)
        assert rows(signals.alerts(store), "cycle", "icao24") == alerts
        assert rows(signals.hourly(store), "hour_utc", "ghost_count", "low_alt_count", "updated_at") == hours
        found.append(contents(store))
    assert found[0] == found[1] == found[2] and len(found[0]["runs"]) == len(times) + 2


def test_history_log_by_stream(spark, job, tmp_path):
    landing, _ = job
    land(landing, 0, [vector("a"), vector("g", ground=True)])
    land(landing, 1, [vector("a"), vector("b")])
    path, checkpoint = str(tmp_path / "history"), str(tmp_path / "history-checkpoint")

    def run():
        ingest.start_history(spark, str(landing), path, checkpoint, max_files=1).awaitTermination()
        return rows(read_history(spark, path), "icao24", "ingested_at")

    stored = [("a", utc(0)), ("a", utc(1)), ("b", utc(1))]
    assert run() == stored
    write_history(ingest.accept(parse_states(vectors_of(spark, landing / "cycle-001.json"))), 1, path)
    assert rows(read_history(spark, path), "icao24", "ingested_at") == stored
    land(landing, 50, [vector("c")])  # two and a half hours later
    assert run() == [("c", utc(50))]


def test_hourly_stream_with_watermark(spark, tmp_path):
    source, out = tmp_path / "rows", str(tmp_path / "out")
    seconds = [START + 3600 * hour + late for hour in range(3) for late in (0, 60)]
    blank = dict.fromkeys(LIVE.fieldNames()) | {"on_ground": False}
    data = [
        {**blank, "icao24": str(n % 2), "ingested_at": datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)}
        for n, t in enumerate(seconds)
    ]
    spark.createDataFrame(data, LIVE).write.parquet(str(source))
    hourly = anomalies.stream_history_hourly(spark.readStream.schema(LIVE).parquet(str(source)), timedelta(seconds=180))
    writer = hourly.writeStream.format("parquet").outputMode("append").option("path", out)
    writer = writer.option("checkpointLocation", str(tmp_path / "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    batch = rows(anomalies.history_hourly(spark.read.parquet(str(source))), "hs", "aircraft")
    got = rows(spark.read.parquet(out), "hs", "aircraft")
    assert len(got) >= 2 and got == batch[: len(got)]  # the last hour stays open until the watermark passes it


def test_batches_of_a_registered_query_do_not_grow_in_number_with_the_files(spark, tmp_path):
    """Each batch goes through the whole live table, so many files come in larger batches, not in more of them."""
    from types import SimpleNamespace

    from skywake.plans import queries

    landing = tmp_path / "landing"
    landing.mkdir()
    for number in range(12):
        land(landing, number, [vector(f"b{number:02d}"), vector("all", altitude=1000.0 * number)], START + number)
    (landing / "_SUCCESS").write_text("")
    assert queries._batch_files(spark, str(landing)) == 3
    assert queries._batch_files(spark, str(tmp_path / "none")) == queries.BATCH_FILES
    fake = SimpleNamespace(spark=spark, write_documents=lambda: str(landing))
    counts, last = queries._counted(fake)
    got = {r.band: r.flight_count for r in maintenance.altitude_distribution(counts, last).collect()}
    assert sum(got.values()) == 13
    store = queries._ingested(fake, batches=True)
    assert 1 < len(store.observed.batches()) <= queries.BATCHES


class Held:
    """The state of a bucket, as Spark gives it to `run_bucket`."""

    def __init__(self):
        self.row, self.mark, self.hasTimedOut = None, 0, False

    exists = property(lambda self: self.row is not None)
    get = property(lambda self: self.row)
    getCurrentWatermarkMs = lambda self: self.mark
    setTimeoutTimestamp = lambda self, at: None

    def update(self, row):
        self.row = row

    def remove(self):
        self.row = None


def _bucket(vectors, cycles, marks):
    """The signals of a bucket that is told of vectors and cycles, then of one watermark after the other."""
    beats = [(None, c, None, None, False, False, 0, 0, 0) for c in cycles]
    came, state, found = pd.DataFrame(vectors + beats, columns=signals.SEEN), Held(), []
    for mark in [0, *marks]:
        state.mark = mark * 1000
        found += list(signals.run_bucket((0,), iter([] if state.hasTimedOut else [came]), state))
        state.hasTimedOut = True
    return pd.concat(found), state


def test_a_bucket_goes_through_its_rows_once_however_many_snapshots_wait():
    rng = random.Random(3)
    cycles = [START + n * 180 for n in range(2000)]
    seen_at = [(f"{a:05x}", cycles[k]) for a in range(3000) for k in rng.sample(range(2000), 3)]
    vectors = [(icao, at, None, "Spain", rng.random() < 0.8, rng.random() < 0.5, at, 1, n) for n, (icao, at) in enumerate(seen_at)]
    clock = time.process_time()
    found, _ = _bucket(vectors, cycles, [cycles[-1]])
    assert time.process_time() - clock < 5
    counts = found[found["kind"] == "count"].set_index("cycle")
    assert len(counts) == len(cycles)
    last = counts.loc[cycles[-1]]
    latest = {}
    for row in sorted(vectors, key=lambda row: row[1]):
        latest[row[0]] = row
    seen = [row for row in latest.values() if cycles[-1] - row[1] <= signals._KEEP]
    assert last["ghost_count"] == sum(row[4] and cycles[-1] - row[1] > signals._AGE for row in seen)
    assert last["low_alt_count"] == sum(row[5] for row in seen)


def test_what_a_bucket_says_does_not_depend_on_where_the_watermark_stops():
    rng = random.Random(4)
    cycles = sorted(rng.sample(range(START, START + 20_000), 60))
    vectors = [(f"a{rng.randrange(12)}", time, None, None, rng.random() < 0.8, rng.random() < 0.5, rng.randrange(3), rng.randrange(3), n) for n, time in enumerate(cycles * 4)]
    whole, held = _bucket(vectors, cycles, [cycles[-1]])
    parts, kept = _bucket(vectors, cycles, [cycles[7], cycles[8] - 1, cycles[8], cycles[40], cycles[-1]])
    told = lambda frame: sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False)))
    assert told(whole) == told(parts)
    assert {"alert", "count"} == set(whole["kind"])
    ends = [signals._held(state) for state in (held, kept)]
    assert sorted(map(tuple, ends[0][0].astype(object).to_numpy().tolist()), key=str) == sorted(map(tuple, ends[1][0].astype(object).to_numpy().tolist()), key=str)
    assert ends[0][1:] == ends[1][1:] == ([], cycles[-1])


def test_buckets_of_the_keyed_state_grow_with_its_vectors(spark, tmp_path, monkeypatch):
    from skywake.plans import queries

    store = Store(spark, str(tmp_path / "store"), BUCKETS)
    assert queries._signal_buckets(store) == queries.BUCKETS
    log = spark.createDataFrame([("a",)] * 200, "icao24 string")
    store.observed.write(0, log.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in store.observed.schema)))
    monkeypatch.setattr(queries, "BUCKET_VECTORS", 2)
    assert queries._signal_buckets(store) == 100
    monkeypatch.setattr(queries, "BUCKET_VECTORS", 1 / 8)
    assert queries._signal_buckets(store) == signals.BUCKETS
