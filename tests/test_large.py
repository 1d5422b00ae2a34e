"""A document that many tasks read gives what the JSON reader gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skywake.sources import snapshots as wire
from skywake.sources.large import _begins, _records, scan_large_documents


def _vector(rng, n):
    odd = ["BA1 ", None, 'a "quoted" one', "br]ack[ets {", "back\\slash\\", "é日]", ""]
    return [f"{n:06x}", rng.choice(odd), rng.choice(["Spain", "Côte d'Ivoire", "x],[y"]), 1, 2, n / 7, -n / 9, 100.5, rng.random() < 0.2, 200, 90, 0,
            rng.choice([None, [1, 2], [[3], {"a": [4]}], []]), 110.25]


def _states(rng, count):
    extra = [None, 3.5, "text ] with [", {"odd": [1, {"b": "]"}]}, [], True]
    found = []
    for n in range(count):
        found += [rng.choice(extra) for _ in range(rng.choice([0, 0, 0, 1, 2]))] + [_vector(rng, n)]
    return found + rng.choice([[], [None], ["end", 1]])


def _rows(frame):
    return [(r.time, r.vec) for r in frame.orderBy("file", "position").collect()]


LAYOUTS = [{"separators": (",", ":")}, {}, {"indent": 1}, {"indent": "\t", "separators": (" ,", " : ")}, {"ensure_ascii": False}]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_any_layout_in_many_splits(spark, tmp_path, small_splits, layout):
    rng = random.Random(str(layout))
    for number, count in enumerate((150, 40, 1, 0)):
        body = {"time": 1_700_000_000 + number, "states": _states(rng, count)}
        if number == 1:
            body = {"states": body["states"], "time": body["time"]}
        (tmp_path / f"doc-{number}.json").write_text(json.dumps(body, **layout), encoding="utf-8")
    whole, split = wire.scan_state_snapshots(spark, str(tmp_path)), scan_large_documents(spark, str(tmp_path))
    assert _records(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
    assert split.columns == whole.columns
    assert _rows(split) == _rows(whole)
    accepted = wire.valid_states(wire.parse_states(split))
    assert accepted.count() == wire.valid_states(wire.parse_states(whole)).count() > 100


@pytest.mark.parametrize("text", ["", "{}", '{"time": 5, "states": null}', '{"time": 5, "states": []}', '{"states": [[]]}', '{"time": 5, "states": [ ], "more": [[1], 2]}', "[1, 2]", "]]", "no json"])
def test_documents_with_little_in_them(spark, tmp_path, text):
    (tmp_path / "doc.json").write_text(text)
    found = _rows(scan_large_documents(spark, str(tmp_path)))
    assert [vec for _, vec in found] == ([[]] if text == '{"states": [[]]}' else [])


def test_a_vector_over_several_splits(spark, tmp_path, small_splits):
    long = _vector(random.Random(1), 7)
    long[1] = "x]" * 6_000  # longer than several splits
    states = [_vector(random.Random(2), 1), long, _vector(random.Random(3), 2)]
    (tmp_path / "doc.json").write_text(json.dumps({"time": 9, "states": states}))
    assert _rows(scan_large_documents(spark, str(tmp_path))) == _rows(wire.scan_state_snapshots(spark, str(tmp_path)))
    records = _records(spark, str(tmp_path))
    assert _begins(records).where("within = 1").count() > 1  # splits that begin within the text


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    lines = [json.dumps(_vector(rng, n)) for n in range(500)]
    body = ",".join(lines * 100)
    (tmp_path / "doc.json").write_text('{"time": 1, "states": [' + body + "]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert spark.read.option("lineSep", "]").text(str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4
        found = scan_large_documents(spark, str(tmp_path))
        assert found.count() == 50_000 and found.select(F.xxhash64("vec").alias("h")).distinct().count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
