from datetime import timedelta

from pyspark.sql import functions as F

from fixed_time import NOW
from skywake.operators import snapshots


def by_key(frame, key="icao24"):
    return {row[key]: row for row in frame.collect()}


def test_upsert_replaces_whole_rows(spark, live_rows, ago):
    live = live_rows([
        {"icao24": "a", "callsign": "OLD", "velocity": 1.0, "ingested_at": ago(minutes=3)},
        {"icao24": "b", "callsign": "KEPT", "ingested_at": ago(minutes=3)},
    ])
    batch = live_rows([{"icao24": "a", "callsign": None}, {"icao24": "c"}]).withColumn("seq", F.lit(1))
    merged = by_key(snapshots.upsert_live(live, batch, [F.desc("seq")], NOW))
    assert set(merged) == {"a", "b", "c"}
    assert merged["a"].callsign is None and merged["a"].velocity is None and merged["a"].ingested_at == NOW
    assert merged["b"].callsign == "KEPT" and merged["b"].ingested_at == ago(minutes=3)


def test_last_of_several_rows_wins_and_a_replay_changes_nothing(spark, live_rows, ago):
    live = live_rows([{"icao24": "a", "ingested_at": ago(minutes=3)}])
    first = live_rows([{"icao24": "a", "callsign": "ONE"}]).withColumn("seq", F.lit(1))
    second = live_rows([{"icao24": "a", "callsign": "TWO"}]).withColumn("seq", F.lit(2))
    batch = first.unionByName(second)
    once = snapshots.upsert_live(live, batch, [F.desc("seq")], NOW)
    assert [row.callsign for row in once.collect()] == ["TWO"]
    twice = snapshots.upsert_live(once, batch, [F.desc("seq")], NOW)
    assert once.collect() == twice.collect()


def test_a_late_snapshot_does_not_replace_newer_rows(spark, live_rows, ago):
    live = live_rows([{"icao24": "a", "callsign": "NEW"}])
    late = live_rows([{"icao24": "a", "callsign": "LATE", "ingested_at": ago(minutes=9)}]).withColumn("seq", F.lit(1))
    assert [row.callsign for row in snapshots.upsert_live(live, late, [F.desc("seq")]).collect()] == ["NEW"]


def test_retention_keeps_the_boundary(spark, live_rows, ago):
    live = live_rows([
        {"icao24": "edge", "ingested_at": ago(minutes=30)},
        {"icao24": "old", "ingested_at": ago(minutes=30, microseconds=1)},
        {"icao24": "new"},
    ])
    assert set(by_key(snapshots.purge_stale_live(live, NOW))) == {"edge", "new"}


def test_run_retention_is_a_parameter(run_rows, ago):
    log = run_rows([{"run_at": ago(days=2)}, {"run_at": ago(days=4)}, {"run_at": ago(days=31)}])
    assert snapshots.purge_runs(log, NOW).count() == 1
    assert snapshots.purge_runs(log, NOW, timedelta(days=30)).count() == 2


def test_history_is_stored_by_hour_and_pruned_by_folder(spark, live_rows, ago, tmp_path):
    rows = live_rows([
        {"icao24": "a"},
        {"icao24": "b", "ingested_at": ago(hours=5)},
        {"icao24": "c", "ingested_at": ago(minutes=50)},
        {"icao24": "g", "on_ground": True},
    ])
    path = str(tmp_path / "history")
    snapshots.append_history(rows, path)
    stored = spark.read.schema(snapshots.history_rows(rows).schema).parquet(path)
    assert set(by_key(stored)) == {"a", "b", "c"}
    kept = snapshots.purge_history(stored, NOW, partition_hour="ingest_hour")
    assert set(by_key(kept)) == {"a", "c"}
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
    assert "PartitionFilters: [isnotnull(ingest_hour" in plan


def test_empty_batch_is_logged_as_error(spark, live_rows):
    ok = snapshots.run_row(live_rows([{}, {}]), NOW, 100, 200).collect()[0]
    assert (ok.records_fetched, ok.records_upserted, ok.upsert_ms, ok.status, ok.error_msg) == (2, 2, 200, "success", None)
    none = snapshots.run_row(live_rows([]), NOW, 100, 200).collect()[0]
    assert (none.records_upserted, none.fetch_ms, none.upsert_ms, none.status) == (0, 100, 0, "error")
    assert none.error_msg.startswith("Empty response")


def test_hot_keys_are_cut_before_the_shuffle(spark, live_rows):
    frame = snapshots.latest_by_key(live_rows([{}]), ["icao24"], [F.desc("ingested_at")])
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
