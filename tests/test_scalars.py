import pytest
from pyspark.sql import functions as F

from skywake.functions import geo, scalars as S


def values(spark, rows, column, schema="x double"):
    return [row[0] for row in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_rounding_sends_halves_up(spark):
    assert values(spark, [2.5, -2.5, 0.4, -0.5, 1.49], S.half_up(F.col("x"))) == [3, -2, 0, 0, 1]


def test_filled_number_rejects_null_zero_and_nan(spark):
    got = values(spark, [None, 0.0, -0.0, float("nan"), -1.0, 2.0], S.filled_number(F.col("x")))
    assert got == [False, False, False, False, True, True]


def test_display_id_falls_back_for_empty_callsign(spark):
    got = values(spark, [None, "", " ", "BA1"], S.display_id(F.col("x"), F.lit("abc")), "x string")
    assert got == ["abc", "abc", " ", "BA1"]


def test_strip_removes_every_kind_of_white_space(spark):
    raw = ["  a b ", "\t x　\x1c", "   ", None]
    assert values(spark, raw, S.strip(F.col("x")), "x string") == [r.strip() if r is not None else None for r in raw]


@pytest.mark.parametrize(
    ("callsign", "airline"),
    [
        ("DLH1", "Delta"),
        ("DL1", "Delta"),
        ("LH1", "Lufthansa"),
        ("UAE1", "Emirates"),
        ("UA1", "United"),
        ("uae1", "Other"),
        ("", "Other"),
        (None, "Other"),
        ("AIC7", "Air India"),
    ],
)
def test_airline_by_first_matching_prefix(spark, callsign, airline):
    assert values(spark, [callsign], S.airline_name(F.col("x")), "x string") == [airline]


def test_longest_prefix_separates_lufthansa(spark):
    got = values(spark, ["DLH1", "DL1", "DAL1"], S.airline_name(F.col("x"), longest_prefix=True), "x string")
    assert got == ["Lufthansa", "Delta", "Delta"]


def test_altitude_bands_at_their_edges(spark):
    feet = [-100.0, 0.0, 2999.9, 3000.1, 14999.9, 15000.1, 44999.9, 45000.1]
    meters = [f / 3.28084 for f in feet]
    got = values(spark, [*meters, None], S.altitude_band(F.lit(False), F.col("x")))
    assert got == ["Low", "Low", "Low", "Climbing", "Climbing", "Cruise", "Cruise", "High Alt", "Ground"]
    assert values(spark, [9000.0], S.altitude_band(F.lit(True), F.col("x"))) == ["Ground"]


def test_low_altitude_excludes_sea_level_and_ground(spark):
    rows = [(False, 0.0), (False, -1.0), (False, 900.0), (False, 915.0), (False, None), (True, 100.0)]
    frame = spark.createDataFrame(rows, "g boolean, x double")
    got = [row[0] for row in frame.select(S.is_low_altitude(F.col("g"), F.col("x"))).collect()]
    assert got == [False, False, True, False, False, False]


def test_performance_bands(spark):
    meters = [f / 3.28084 for f in (500, 1500, 9999, 10001, 24999, 39999, 40001)]
    assert values(spark, meters, S.performance_band5(F.col("x"))) == [
        "ground", "low", "low", "climbing", "climbing", "cruise", "high",
    ]
    assert values(spark, meters, S.performance_band3(F.col("x"))) == [
        "low", "low", "climbing", "climbing", "cruise", "cruise", "cruise",
    ]


def test_fixed_decimals_round_exact_ties_away_from_zero(spark):
    # 1.45 lies below the tie as a double, 0.25 and 0.75 are ties.
    got = values(spark, [1.45, 0.25, 0.75, -0.25, 100.0, 12.34, 1234.5], S.to_fixed(F.col("x"), 1))
    assert got == ["1.4", "0.3", "0.8", "-0.3", "100.0", "12.3", "1234.5"]
    assert values(spark, [0.03125, -0.03125], S.to_fixed(F.col("x"), 4)) == ["0.0313", "-0.0313"]


def test_altitude_text_groups_digits(spark):
    got = values(spark, [10668.0, 0.0, None, -100.0], S.altitude_text(F.col("x")))
    assert got == ["35,000 ft", None, None, "-328 ft"]


def test_longitude_bins_end_before_180(spark):
    assert values(spark, [-180.0, -175.0, 0.0, 179.999, 180.0], geo.longitude_bin(F.col("x"))) == [0, 1, 36, 71, 72]


def test_mercator_pixels(spark):
    assert values(spark, [-180.0, 0.0, 180.0], geo.world_x(F.col("x"), 1)) == [0.0, 256.0, 512.0]
    top, middle, bottom, beyond = values(spark, [85.0511287798, 0.0, -85.0511287798, 90.0], geo.world_y(F.col("x"), 1))
    assert top == pytest.approx(0.0, abs=1e-6) and bottom == pytest.approx(512.0, abs=1e-6)
    assert middle == pytest.approx(256.0) and beyond == top
