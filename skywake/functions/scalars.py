"""Column expressions over state vectors. All of them stay inside code generation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from skywake import constants as K

# Fixed value: the characters that count as white space at either end of a text field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def moment(as_of: Column | datetime) -> Column:
    """A reference time given as a column, such as a scalar subquery, or as a datetime.

    A datetime without a zone is a UTC wall-clock time, whatever the zone of the driver.
    """
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of) if as_of.tzinfo else F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def hour_of(moment: Column) -> Column:
    """The start of the hour of a time without a zone, whatever the session's zone: its fields are read, not an instant."""
    return F.make_timestamp_ntz(F.year(moment), F.month(moment), F.day(moment), F.hour(moment), F.lit(0), F.lit(0))


def day_of(moment: Column) -> Column:
    """The start of its day, likewise."""
    return F.make_timestamp_ntz(F.year(moment), F.month(moment), F.day(moment), F.lit(0), F.lit(0), F.lit(0))


def feet(meters: Column) -> Column:
    return meters * F.lit(K.FEET_PER_METER)


def knots(meters_per_second: Column) -> Column:
    return meters_per_second * F.lit(K.KNOTS_PER_METER_PER_SECOND)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with the fraction, for either timestamp type."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)


def half_up(value: Column) -> Column:
    """Rounding with halves towards plus infinity, as browsers round."""
    return F.floor(value + F.lit(0.5))


def percent_of(part: Column, whole: Column) -> Column:
    return half_up(part / whole * F.lit(100))


def filled_number(value: Column) -> Column:
    """True for a number that is neither null, zero nor NaN."""
    return value.isNotNull() & (value != 0) & ~F.isnan(value)


def filled_text(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends.

    Nearly all padding is plain blanks, so the full set is only searched where something unusual remains.
    """
    trimmed = F.trim(value)
    usual = F.ascii(trimmed).between(33, 126) & F.ascii(F.substring(trimmed, -1, 1)).between(33, 126)
    return F.when(usual, trimmed).otherwise(F.btrim(trimmed, F.lit(WHITESPACE)))


def display_id(callsign: Column, icao24: Column) -> Column:
    """The callsign, or the address where the callsign is null or empty."""
    return F.coalesce(F.nullif(callsign, F.lit("")), icao24)


def to_fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties away from zero.

    ``format_number`` is exact but breaks ties to even. A double is a tie at ``digits`` decimals only if it
    is an odd multiple of ``2**-(digits + 1)``; scaling such a value by ``10**digits`` loses nothing.
    """
    scale = F.lit(float(10**digits))
    steps = F.abs(value) * F.lit(float(2 ** (digits + 1)))
    away = F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5)) / scale
    exact = F.when(steps == F.floor(steps), away).otherwise(value)
    return F.replace(F.format_number(exact, digits), F.lit(","), F.lit(""))


def grouped_digits(whole: Column) -> Column:
    """A whole number as text with thousands separators."""
    return F.format_number(whole, 0)


def airline_name(callsign: Column, longest_prefix: bool = False) -> Column:
    """Airline by callsign prefix. ``longest_prefix`` puts DLH to Lufthansa instead of Delta."""
    rules = [(prefix, name) for name, prefixes in K.AIRLINE_PREFIXES for prefix in prefixes]
    if longest_prefix:
        rules.sort(key=lambda rule: -len(rule[0]))
    chain = F
    for prefix, name in rules:
        chain = chain.when(callsign.startswith(prefix), F.lit(name))
    return chain.otherwise(F.lit(K.OTHER_AIRLINE))


def _stepwise(value: Column, steps: list[tuple[str, int]], top: str, chain=F) -> Column:
    for name, bound in steps:
        chain = chain.when(value < bound, F.lit(name))
    return chain.otherwise(F.lit(top))


def altitude_band(on_ground: Column, geo_altitude: Column) -> Column:
    """Airborne rows without an altitude belong to the ground band."""
    grounded = F.when(on_ground | geo_altitude.isNull(), F.lit(K.GROUND_BAND))
    return _stepwise(feet(geo_altitude), K.ALTITUDE_BANDS, K.TOP_ALTITUDE_BAND, grounded)


def performance_band3(geo_altitude: Column) -> Column:
    return _stepwise(feet(geo_altitude), K.PERFORMANCE_BANDS_3, K.PERFORMANCE_TOP_3)


def performance_band5(geo_altitude: Column) -> Column:
    return _stepwise(feet(geo_altitude), K.PERFORMANCE_BANDS_5, K.PERFORMANCE_TOP_5)


def is_airborne_positioned(on_ground="on_ground", lat="lat", lon="lon") -> Column:
    return ~F.col(on_ground) & F.col(lat).isNotNull() & F.col(lon).isNotNull()


def is_low_altitude(on_ground: Column, geo_altitude: Column) -> Column:
    """Airborne below 3,000 ft; at or below sea level does not count."""
    altitude = feet(geo_altitude)
    return ~on_ground & geo_altitude.isNotNull() & (altitude < K.LOW_ALTITUDE_FEET) & (altitude > 0)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def altitude_text(geo_altitude: Column) -> Column:
    return F.when(
        filled_number(geo_altitude),
        F.concat(grouped_digits(half_up(feet(geo_altitude))), F.lit(" ft")),
    )


def feed_message(kind: Column, callsign: Column, icao24: Column, country: Column, geo_altitude: Column) -> Column:
    """Text of a feed event: lost signal, cruise altitude or contact."""
    who = display_id(callsign, icao24)
    return (
        F.when(kind == "ghost", F.concat(who, F.lit(" transponder signal lost")))
        .when(
            kind == "cruise",
            F.concat(who, F.lit(" reached cruise altitude "), F.coalesce(altitude_text(geo_altitude), F.lit("null"))),
        )
        .otherwise(F.concat(who, F.lit(" ("), F.coalesce(country, F.lit(K.NO_VALUE)), F.lit(") contact established")))
    )
