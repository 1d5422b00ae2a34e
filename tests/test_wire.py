import json
import os

import pytest
from pyspark.sql import functions as F

from skywake.sources import snapshots as wire


def vector(**changes):
    fields = ["ABC123 ", "BA1  ", "Spain", 1, 2, 1.5, 2.5, 100, False, 200.5, 90, 0, None, 110.25, None, False, 0]
    for place, value in changes.items():
        fields[int(place[1:])] = value
    return fields


def scan(spark, tmp_path, states, **options):
    (tmp_path / "snapshot.json").write_text(json.dumps({"time": 1700000000, "states": states}, **options))
    return wire.scan_state_snapshots(spark, str(tmp_path))


def only(spark, tmp_path, row):
    return wire.parse_states(scan(spark, tmp_path, [row])).collect()[0]


def test_a_valid_vector(spark, tmp_path):
    row = only(spark, tmp_path, vector())
    assert row.reject_reason is None
    assert (row.icao24, row.callsign, row.origin_country) == ("abc123", "BA1", "Spain")
    assert (row.lon, row.lat, row.baro_altitude, row.geo_altitude) == (1.5, 2.5, 100.0, 110.25)
    assert (row.on_ground, row.velocity, row.true_track, row.vertical_rate) == (False, 200.5, 90.0, 0.0)


@pytest.mark.parametrize(
    ("changes", "field", "value"),
    [
        ({"_0": None}, "icao24", "none"),
        ({"_1": "   "}, "callsign", ""),
        ({"_1": ""}, "callsign", None),
        ({"_1": None}, "callsign", None),
        ({"_2": ""}, "origin_country", None),
        ({"_8": True}, "on_ground", True),
        ({"_8": None}, "on_ground", False),
        ({"_8": 0}, "on_ground", False),
        ({"_8": 1}, "on_ground", True),
        ({"_9": None}, "velocity", None),
        ({"_9": "12.5"}, "velocity", 12.5),
        ({"_9": " 1_0.5e1 "}, "velocity", 105.0),
        ({"_9": True}, "velocity", 1.0),
        ({"_1": 0}, "callsign", None),
        ({"_1": 12}, "callsign", "12"),
        ({"_2": False}, "origin_country", None),
        ({"_8": "false"}, "on_ground", True),
        ({"_8": ""}, "on_ground", False),
        ({"_8": [0]}, "on_ground", True),
        ({"_8": {}}, "on_ground", False),
    ],
)
def test_fields(spark, tmp_path, changes, field, value):
    row = only(spark, tmp_path, vector(**changes))
    assert row.reject_reason is None
    assert row[field] == value


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (vector(_0="  "), "empty_icao24"),
        (vector()[:13], "short_vector"),
        ([], "short_vector"),
        (vector(_9="fast"), "bad_number"),
        (vector(_13="n/a"), "bad_number"),
        (vector(_13="8.0d"), "bad_number"),
        (vector(_13="true"), "bad_number"),
        (vector(_13=[1]), "bad_number"),
        ({"a": 1}, "no_vector"),
        ("text", "no_vector"),
        (7, "no_vector"),
        (None, "no_vector"),
        (vector(_6=None), "no_position"),
        (vector(_5=None), "no_position"),
    ],
)
def test_rejections(spark, tmp_path, row, reason):
    assert only(spark, tmp_path, row).reject_reason == reason


def test_an_odd_element_costs_one_row(spark, tmp_path):
    rows = wire.parse_states(scan(spark, tmp_path, [vector(), {"a": [1]}, "text", None, 3.5, [], vector(_0="x")])).collect()
    assert [(r.position, r.reject_reason) for r in rows if r.reject_reason] == [(1, "no_vector"), (2, "no_vector"), (3, "no_vector"), (4, "no_vector"), (5, "short_vector")]
    assert [r.icao24 for r in rows if not r.reject_reason] == ["abc123", "x"]


def test_fourteen_fields_suffice(spark, tmp_path):
    assert only(spark, tmp_path, vector()[:14]).reject_reason is None


def test_ground_rows_need_no_position(spark, tmp_path):
    parsed = wire.parse_states(scan(spark, tmp_path, [vector(_5=None, _6=None, _8=True)]))
    assert wire.valid_states(parsed).count() == 1


@pytest.mark.parametrize("states", [None, []])
def test_empty_snapshots_give_no_rows(spark, tmp_path, states):
    assert scan(spark, tmp_path, states).count() == 0


def test_missing_states_and_pretty_printed_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"time": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"time": 2, "states": [vector(), vector(_0="x")]}, indent=2))
    rows = wire.scan_state_snapshots(spark, str(tmp_path)).collect()
    assert [(row.time, row.position) for row in rows] == [(2, 0), (2, 1)]


def test_a_document_without_time_takes_that_of_its_file(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"states": [vector()]}))
    os.utime(path, (1_600_000_000, 1_600_000_000))
    assert wire.scan_state_snapshots(spark, str(tmp_path)).collect()[0].time == 1_600_000_000


def test_one_document_per_line(spark, tmp_path):
    lines = [json.dumps({"time": t, "states": [vector(_0=f"a{t}")]}) for t in range(5)]
    (tmp_path / "many.json").write_text("\n".join(lines))
    rows = wire.scan_state_snapshots(spark, str(tmp_path), multi_line=False)
    assert sorted(row.time for row in rows.collect()) == [0, 1, 2, 3, 4]


def test_typed_rows_follow_the_same_rule(spark, live_rows):
    rows = live_rows([
        {"icao24": "a", "lat": 1.0, "lon": 1.0},
        {"icao24": "b", "lat": 1.0},
        {"icao24": "c", "on_ground": True},
        {"icao24": "", "on_ground": True},
    ])
    assert sorted(row.icao24 for row in wire.accept_typed(rows).collect()) == ["a", "c"]


def test_other_columns_stay(spark, tmp_path):
    parsed = wire.parse_states(scan(spark, tmp_path, [vector()]).withColumn("feed", F.lit("x")))
    assert {"time", "file", "position", "feed"} <= set(parsed.columns)


def test_a_text_that_its_kind_may_change_is_told_apart_in_any_vector(spark):
    """Vectors whose fields all stay as they are take a shorter way than others; both give the same texts."""
    plain = ["a1", "BA1", "Spain", None, None, "1.5", 2, 3, False, "4.0", 5, 6, None, 7]
    odd = {1: ["", 0, "0", -0.0, "-0", False, "false", [], {}, "[]", "lh1"], 2: [False, "false", "x"], 8: [True, "true", "false", 0, "0", None, "", [], [0]], 9: [True, "true", "false", False]}
    vectors = [plain] + [plain[:place] + [value] + plain[place + 1 :] for place, values in odd.items() for value in values]
    frame = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(vectors)], "n int, e string")
    texts = [row.vec for row in frame.select("n", wire.vector_texts(F.col("e")).alias("vec")).orderBy("n").collect()]
    as_text = [None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in plain]
    assert texts[0] == as_text
    expected = {
        1: [None, None, "0", None, "-0", None, "false", None, None, "[]", "lh1"], 2: [None, "false", "x"],
        8: ["true", "true", "true", "false", "true", "false", "false", "false", "true"], 9: ["1", "true", "false", "0"],
    }
    found = [(place, value) for place, values in expected.items() for value in values]
    for (place, value), text in zip(found, texts[1:], strict=True):
        assert text == as_text[:place] + [value] + as_text[place + 1 :]
