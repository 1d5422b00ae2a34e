"""Reading, parsing and validating raw snapshots of state vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywake.functions import scalars as S
from skywake.schemas import SNAPSHOT, STATE_COLUMNS

# Position of each number in the vector.
NUMBER_POSITIONS = {
    "lon": 5,
    "lat": 6,
    "baro_altitude": 7,
    "velocity": 9,
    "true_track": 10,
    "vertical_rate": 11,
    "geo_altitude": 13,
}
TEXT_POSITIONS = (1, 2)
GROUND_POSITION = 8
VECTOR_LENGTH = 14
#: Fields of a vector that are typed in one step.
FIELDS_AT_ONCE = 3
# A number as text: digits may be grouped by underscores, as the feed's consumers read them.
LIST = r"^\s*\["
DECIMAL = r"^-?[0-9]+(?:\.[0-9]+)?$"
NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"


def explode_snapshots(snapshots: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per vector with its snapshot time, file and place.

    An empty or missing list gives no row, or with ``keep_empty`` one row without a vector. A document without
    a time gets that of its file.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    landed = F.col("_metadata.file_modification_time")
    return snapshots.select(
        F.coalesce("time", F.unix_seconds(landed)).alias("time"),
        landed.alias("landed"),
        F.col("_metadata.file_path").alias("file"),
        explode("states").alias("position", "vec"),
    ).withColumn("vec", vector_texts(F.col("vec")))


def vector_texts(element: Column) -> Column:
    """The fields of one element as texts for ``parse_states``; null for an element that is no list.

    JSON tells 1, true, "1" and "true" apart, a text does not. So what a field's place makes of its kind is settled here: a
    boolean is a number where one is due, anything that is not false, zero or empty is true on the ground, and a callsign
    or country that is none of these is missing.

    An element is parsed once, if it can be a list, and its texts are taken in one go. Fields are gone through one by one only in a
    vector with a text that its kind may change.
    """

    def kind(parsed: Column, place: Column) -> Column:
        return F.schema_of_variant(F.get(F.try_variant_get(parsed, "$", "array<variant>"), place))

    def text(parsed: Column, plain: Column, place: Column) -> Column:
        zero = F.when(plain.startswith("0") | plain.startswith("-0"), plain.try_cast("double") == 0)
        empty = (
            F.when(plain == "", F.lit(True))
            .when(plain == "false", kind(parsed, place) == "BOOLEAN")
            .when(plain.isin("[]", "{}") | F.coalesce(zero, F.lit(False)), kind(parsed, place) != "STRING")
            .otherwise(F.lit(False))
        )
        number = F.when(kind(parsed, place) != "BOOLEAN", plain).when(plain == "true", "1").otherwise("0")
        return (
            F.when(place == GROUND_POSITION, F.when(plain.isNull() | empty, "false").otherwise("true"))
            .when(place.isin(*NUMBER_POSITIONS.values()) & plain.isin("true", "false"), number)
            .when(place.isin(*TEXT_POSITIONS) & empty, F.lit(None).cast("string"))
            .otherwise(plain)
        )

    def settled(parsed: Column, plains: Column) -> Column:
        """Whether every field stays as it is."""
        at = lambda place: F.get(plains, F.lit(place))
        ground = at(GROUND_POSITION)
        ground_kind = F.schema_of_variant(F.try_variant_get(parsed, f"$[{GROUND_POSITION}]", "variant"))
        found = (ground == "true") | ((ground == "false") & (ground_kind == "BOOLEAN"))
        for place in TEXT_POSITIONS:
            found &= at(place).isNull() | (at(place).rlike("^[A-Z ]"))
        for place in NUMBER_POSITIONS.values():
            found &= at(place).isNull() | ~at(place).isin("true", "false")
        return F.coalesce(found, F.lit(False))

    def texts(parsed: Column, plains: Column) -> Column:
        return F.when(settled(parsed, plains), plains).otherwise(F.transform(plains, lambda plain, place: text(parsed, plain, place)))

    def fields(parsed: Column) -> Column:
        plains = F.array(F.try_variant_get(parsed, "$", "array<string>"))
        return F.get(F.transform(plains, lambda found: texts(parsed, found)), F.lit(0))

    return F.get(F.transform(F.array(F.when(element.rlike(LIST), F.try_parse_json(element))), fields), F.lit(0))


def scan_state_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read snapshot documents ``{"time": .., "states": [[..], ..]}``.

    A pretty-printed document needs ``multi_line``. Compact documents, one per line, should be read without
    it: such files can be split among tasks.
    """
    return explode_snapshots(spark.read.schema(SNAPSHOT).json(path, multiLine=multi_line))


def stream_state_snapshots(
    spark: SparkSession, path: str, multi_line: bool = False, max_files: int | None = None
) -> DataFrame:
    """The same scan as a stream over files landing in a folder.

    Empty snapshots stay, to be logged. The file is a digest, which serves to tell files apart as well as the
    path does and does not carry it along with every vector.
    """
    reader = spark.readStream.schema(SNAPSHOT).option("multiLine", multi_line)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    vectors = explode_snapshots(reader.json(path), keep_empty=True)
    return vectors.withColumn("file", F.xxhash64("file"))


def _truth(text: Column) -> Column:
    """Truth of a scalar read as text; null, false, zero and the empty text are false."""
    return (
        F.when(text.isNull() | text.isin("", "false"), F.lit(False))
        .when(text == "true", F.lit(True))
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def _number(text: Column) -> Column:
    """The number a text stands for, else null. Nearly all are plain decimals, which need no more than a cast."""
    plain = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    return plain.when(text.rlike(NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def parse_states(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Type the vectors of a column of text arrays; the other columns stay.

    ``reject_reason`` is null for a valid row. A null address becomes the text ``none``, as the feed's
    consumers expect, and a callsign of white space becomes the empty text.
    """
    array = F.col(vec)
    at = lambda i: F.get(array, F.lit(i))
    typed = {
        "icao24": F.lower(S.strip(F.coalesce(at(0), F.lit("none")))),
        "callsign": S.strip(F.nullif(at(1), F.lit(""))),
        "origin_country": F.nullif(at(2), F.lit("")),
        "on_ground": _truth(at(8)),
    }
    typed |= {name: _number(at(i)) for name, i in NUMBER_POSITIONS.items()}
    # Unpacking a struct fixes the typed fields as columns: a filter on the reason then reads them instead of
    # parsing every text a second time below the projection. Some fields at a time, as the JVM interprets a method
    # of more than 8,000 bytes.
    rows = vectors
    for start in range(0, len(STATE_COLUMNS), FIELDS_AT_ONCE):
        row = F.struct(*[typed[name].alias(name) for name in STATE_COLUMNS[start : start + FIELDS_AT_ONCE]])
        rows = rows.select("*", F.inline(F.array(row)))
    unreadable = F.lit(False)
    for name, i in NUMBER_POSITIONS.items():
        unreadable = unreadable | (at(i).isNotNull() & F.col(name).isNull())
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    reason = (
        F.when(array.isNull(), "no_vector")
        .when(F.size(array) < VECTOR_LENGTH, "short_vector")
        .when(F.col("icao24") == "", "empty_icao24")
        .when(unreadable, "bad_number")
        .when(~F.col("on_ground") & ~placed, "no_position")
    )
    return rows.withColumn("reject_reason", reason).drop(vec)


def valid_states(parsed: DataFrame) -> DataFrame:
    """The accepted rows of ``parse_states``. Ground rows need no position."""
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def accept_typed(states: DataFrame) -> DataFrame:
    """The same acceptance rule for state rows that are typed already."""
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return states.where((F.col("icao24") != "") & (F.col("on_ground") | placed))
