"""Nearest aircraft to each of many points on the projected map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake import constants as K
from skywake.functions import geo, scalars as S
from skywake.operators.ranking import top_per
from skywake.session import shared_dir

FINER = 4  # a cell splits into FINER x FINER cells at the next depth
DEPTHS = 8  # measured at a time
FINEST = 24  # a cell of this depth is smaller than neighbouring doubles are apart
SLACK = 1e-6  # pixels; covers rounding at cell borders when cells are ruled out


def _cell(pixel: Column, radius: float, depth: int) -> Column:
    return F.floor(pixel / F.lit(radius / FINER**depth))


def _gap(pixel: Column, cell: Column, size: float) -> Column:
    """Distance along one axis from a pixel to a cell."""
    low = cell * F.lit(size)
    return F.greatest(low - pixel, pixel - (low + F.lit(size)), F.lit(0.0))


def _needed_depth(spots: DataFrame, radius: float, crowd: int) -> int:
    """The first depth at which no cell holds more than ``crowd`` spots (actions returning at most 9 rows each)."""
    for deepest in range(DEPTHS, FINEST + 1, DEPTHS):
        finest = spots.groupBy(
            _cell(F.col("x"), radius, deepest).alias("cx"), _cell(F.col("y"), radius, deepest).alias("cy")
        ).agg(F.count("*").alias("n"))
        steps = F.sequence(F.lit(deepest - DEPTHS), F.lit(deepest))
        levels = finest.withColumn("depth", F.explode(steps)).withColumn(
            "span", F.pow(F.lit(FINER), F.lit(deepest) - F.col("depth"))
        )
        fullest = (
            levels.groupBy("depth", F.floor(F.col("cx") / F.col("span")), F.floor(F.col("cy") / F.col("span")))
            .agg(F.sum("n").alias("n"))
            .groupBy("depth")
            .agg(F.max("n").alias("fullest"))
        )
        measured = fullest.collect()
        if not measured:
            return 0
        fit = [row.depth for row in measured if row.fullest <= crowd]
        if fit:
            return min(fit)
    return FINEST


def nearest_aircraft(
    points: DataFrame,
    flights: DataFrame,
    zoom: int,
    radius: float = K.HIT_RADIUS_PX,
    crowd: int = 256,
    depth: int | None = None,
) -> DataFrame:
    """For each ``point_id`` the nearest aircraft closer than ``radius`` pixels; points without one give no row.

    Aircraft at one pixel position collapse to the first address. Each point first learns how far an aircraft is at most, its
    ``reach``, from one aircraft in its own cell of each depth. It then looks into those of the 3 x 3 cells of hit-radius size around
    it that its reach touches. Where cells are crowded, the pairs of point and cell are narrowed down on summaries of ever finer cells,
    one row per occupied cell: a cell stays only if its near side is within reach, and what stays shortens the reach. That drops no
    candidate, and no point meets a crowded cell's aircraft one by one. ``crowd`` bounds the aircraft per cell that the last
    step compares, down to cells that hold one place; the depth is measured unless given. The least distance is taken in a hash
    aggregate, and only cells that it touches are asked again for the addresses at it, so a point never moves with its candidates.
    """
    shared_dir(flights.sparkSession)
    lat, lon = F.col("lat"), F.col("lon")
    placed = flights.where(S.filled_number(lat) & lon.isNotNull())
    spots = (
        placed.select("icao24", geo.world_x(lon, zoom).alias("x"), geo.world_y(lat, zoom).alias("y"))
        .groupBy("x", "y")
        .agg(F.min("icao24").alias("icao24"))
        .checkpoint()
    )
    if depth is None:
        depth = _needed_depth(spots, radius, crowd)
    asked = points.where("point_id IS NOT NULL").select("point_id", geo.world_x(lon, zoom).alias("px"), geo.world_y(lat, zoom).alias("py"))

    px, py, near_side = F.col("px"), F.col("py"), _near_side(radius, 0)
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = (_cell(px, radius, 0) + F.col("d.dx")).alias("cx"), (_cell(py, radius, 0) + F.col("d.dy")).alias("cy")
    pairs = (
        _reached(asked, spots, radius, depth)
        .withColumn("d", F.explode(offsets))
        .select("point_id", "px", "py", "reach", *around)
        .where(near_side - SLACK <= F.col("reach"))
    )
    for level in range(1, depth + 1):
        pairs = _narrow(pairs, spots, radius, level)

    cells = spots.withColumn("cx", _cell(F.col("x"), radius, depth)).withColumn("cy", _cell(F.col("y"), radius, depth))
    distance = F.hypot(F.col("x") - px, F.col("y") - py)
    near = pairs.join(cells, ["cx", "cy"]).select("point_id", distance.alias("distance")).where(F.col("distance") < radius)
    least = near.groupBy("point_id").agg(F.min("distance").alias("least"))
    touched = pairs.join(least, "point_id").where(_near_side(radius, depth) - SLACK <= F.col("least"))
    equal = touched.join(cells, ["cx", "cy"]).withColumn("distance", distance).where(F.col("distance") == F.col("least"))
    best = top_per(equal.select("point_id", "icao24", "distance"), ["point_id"], ["icao24"], 1)
    return best.select("point_id", "icao24", F.round("distance", 6).alias("distance_px"))


def _near_side(radius: float, level: int) -> Column:
    """Distance of a point to the cell (cx, cy) of a level."""
    size = radius / FINER**level
    return F.hypot(_gap(F.col("px"), F.col("cx"), size), _gap(F.col("py"), F.col("cy"), size))


def _reached(asked: DataFrame, spots: DataFrame, radius: float, depth: int) -> DataFrame:
    """The points with ``reach``: the radius, or less where an aircraft in the point's own cell of some depth is nearer."""
    at = lambda pixel: F.array(*(_cell(F.col(pixel), radius, level) for level in range(depth + 1)))
    levels = F.arrays_zip(F.sequence(F.lit(0), F.lit(depth)).alias("level"), at("x").alias("cx"), at("y").alias("cy"))
    own = F.arrays_zip(F.sequence(F.lit(0), F.lit(depth)).alias("level"), at("px").alias("cx"), at("py").alias("cy"))
    # Per finest cell first, so that a spot is not repeated for every depth.
    finest = spots.groupBy(_cell(F.col("x"), radius, depth).alias("cx"), _cell(F.col("y"), radius, depth).alias("cy"))
    some = finest.agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y")).select("x", "y", F.inline(levels))
    known = some.groupBy("level", "cx", "cy").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y"))
    met = asked.select("*", F.inline(own)).join(known, ["level", "cx", "cy"], "left")
    nearest_known = F.min(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    return met.groupBy("point_id", "px", "py").agg(F.least(nearest_known, F.lit(float(radius))).alias("reach"))


def _narrow(pairs: DataFrame, spots: DataFrame, radius: float, level: int) -> DataFrame:
    """Replace the cell of each pair by the finer cells in it that may hold the nearest aircraft."""
    x, y = F.col("x"), F.col("y")
    finer = spots.groupBy(
        _cell(x, radius, level - 1).alias("cx"),
        _cell(y, radius, level - 1).alias("cy"),
        _cell(x, radius, level).alias("fx"),
        _cell(y, radius, level).alias("fy"),
    ).agg(F.min("x").alias("some_x"), F.min_by("y", "x").alias("some_y"))
    known = F.hypot(F.col("some_x") - F.col("px"), F.col("some_y") - F.col("py"))
    split = (
        pairs.join(finer, ["cx", "cy"])
        .select("point_id", "px", "py", "reach", F.col("fx").alias("cx"), F.col("fy").alias("cy"), known.alias("known"))
        .withColumn("near_side", _near_side(radius, level))
        .where(F.col("near_side") - SLACK <= F.col("reach"))
    )
    reach = F.least("reach", F.min("known").over(W.partitionBy("point_id")))
    return split.withColumn("reach", reach).where(F.col("near_side") - SLACK <= F.col("reach")).drop("known", "near_side")
