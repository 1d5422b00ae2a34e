"""Regions, longitude bins and density grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skywake import constants as K
from skywake.functions import geo, scalars as S
from skywake.operators.positions import airborne_positioned
from skywake.operators.ranking import groups_of, join_counts


def region_membership(live: DataFrame, regions: Sequence[K.Region] = tuple(K.MAP_REGIONS)) -> DataFrame:
    """One row per aircraft and region that contains it; overlapping regions give several.

    The boxes are a handful of constants, so each row tests them in place and nothing is shuffled.
    """
    hits = [F.when(geo.in_region(F.col("lat"), F.col("lon"), r), F.lit(r.name)) for r in regions]
    return airborne_positioned(live).withColumn("region", F.explode(F.array_compact(F.array(*hits))))


def region_counts(
    live: DataFrame, regions: Sequence[K.Region] = tuple(K.MAP_REGIONS), by: Sequence[str] = ()
) -> DataFrame:
    """Airborne aircraft in each region, with the place of the region in its list; empty ones with zero.

    One conditional count per region in a single pass: no row is multiplied and each map task sends one row.
    """
    lat, lon = F.col("lat"), F.col("lon")
    names = [f"region_{i}" for i in range(len(regions))]
    counts = [F.count_if(geo.in_region(lat, lon, r)).alias(n) for n, r in zip(names, regions)]
    wide = airborne_positioned(live).groupBy(*by).agg(*counts)
    listed = F.array(*[F.struct(F.lit(r.name).alias("region"), F.col(n).alias("n")) for n, r in zip(names, regions)])
    exploded = wide.select(*by, F.posexplode(listed).alias("ord", "entry"))
    return exploded.select(*by, "ord", F.col("entry.region").alias("region"), F.col("entry.n").alias("flight_count"))


#: Cells that a box is covered with, at most; the size of the cells follows from that of the box.
MOST_CELLS = 32
#: Cells in which a box meets aircraft one by one, at most: each is a row that travels with the bounds, and finer ones only save tests.
FEW_CELLS = 9


def covered(regions: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The cells (level, cx, cy) of each box of a table (region, south, west, north, east), and whether a cell lies ``within`` it.

    A box takes the smallest cells of which ``most`` cover it, so a large one has large cells. Bounds are inclusive. A box with a
    missing bound, or with its west behind its east, holds nothing; so one over the date line must be given as two. Rows that
    repeat are one region.
    """
    bounds = ["south", "west", "north", "east"]
    real = regions.select("region", *(F.col(c).cast("double").alias(c) for c in bounds)).where("south <= north AND west <= east").distinct()
    span = lambda low, high, level: geo.cell_of(F.col(high), level) - geo.cell_of(F.col(low), level) + 1
    fits = lambda level: span("west", "east", level) * span("south", "north", level) <= most
    levels = F.sequence(F.lit(geo.FINEST_LEVEL), F.lit(0))
    sized = real.withColumn("level", F.get(F.filter(levels, fits), 0))
    ends = {name: geo.cell_of(F.col(bound), F.col("level")) for name, bound in (("x0", "west"), ("x1", "east"), ("y0", "south"), ("y1", "north"))}
    spread = sized.withColumns(ends).withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    within = (F.col("cx") > F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") > F.col("y0")) & (F.col("cy") < F.col("y1"))
    return spread.select("region", *bounds, "level", "cx", "cy", within.alias("within"))


def _in_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (lat, lon) once for each level that ``cells`` has, with the cell there. The levels are a scalar subquery, 27 at most."""
    levels = cells.agg(F.collect_set("level")).scalar()
    leveled = rows.withColumn("level", F.explode(levels))
    return leveled.withColumn("cx", geo.cell_of(F.col("lon"), F.col("level"))).withColumn("cy", geo.cell_of(F.col("lat"), F.col("level")))


CELL = ["level", "cx", "cy"]


def _in_bounds() -> Column:
    return F.col("within") | (F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))


def region_table_membership(live: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per aircraft and region of a table that contains it; see ``covered``.

    Aircraft and boxes meet by equal cells, then by the exact test, so any number of boxes may overlap. Spark splits a crowded cell.
    """
    cells = covered(regions, FEW_CELLS)
    flying = _in_cells(airborne_positioned(live), cells)
    return flying.join(cells, CELL).where(_in_bounds()).select("region", *live.columns)


#: Strips of longitude that boxes and places meet in, at least; places of a strip and boxes of a group, about.
STRIPS, PLACES, BOXES = 64, 250_000, 500_000


def _counts_within(places: pa.Table, boxes: pa.Table) -> pa.Table:
    """region and n of each box of a group: the aircraft of the group's places that lie in it.

    Places stand in the order of longitude. A box is a stretch of them and a stretch of the ranks of latitudes; what of the one lies
    below a rank is counted bit by bit of the rank, so a box costs the same however many places it holds.
    """
    lon, lat, n = (places[name].to_numpy() for name in ("lon", "lat", "n"))
    order = np.argsort(lon, kind="stable")
    lon, lat, n = lon[order], lat[order], n[order]
    heights = np.unique(lat)
    rank = np.searchsorted(heights, lat)
    bound = {name: boxes[name].to_numpy() for name in ("south", "west", "north", "east")}
    first, last = np.searchsorted(lon, bound["west"], "left"), np.searchsorted(lon, bound["east"], "right")
    upto = [np.searchsorted(heights, bound["north"], "right"), np.searchsorted(heights, bound["south"], "left")]
    ends = [(first.copy(), last.copy()) for _ in upto]
    found = [np.zeros(len(first), np.int64) for _ in upto]
    for bit in reversed(range(max(1, int(len(heights)).bit_length()))):
        one = (rank >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        weight = np.concatenate([[0], np.cumsum(np.where(one == 0, n, 0))])
        for k, (below, (lo, hi)) in enumerate(zip(upto, ends)):
            high = ((below >> bit) & 1).astype(bool)
            found[k] += np.where(high, weight[hi] - weight[lo], 0)
            ends[k] = tuple(np.where(high, zeros[-1] + at - zeros[at], zeros[at]) for at in (lo, hi))
        by_bit = np.argsort(one, kind="stable")
        rank, n = rank[by_bit], n[by_bit]
    return pa.table({"region": boxes["region"], "n": pa.array(found[0] - found[1], pa.int64())})


def region_table_traffic(live: DataFrame, regions: DataFrame) -> DataFrame:
    """Airborne aircraft in each region of a table, empty ones with zero, most first (an action).

    Places are dealt to strips of longitude that hold about equally many, aircraft at one place are one. A box goes once to each
    strip it touches, with its bounds alone, and is counted there, see ``_counts_within``. Boxes of a crowded strip are dealt to several
    groups, each with the strip's places. Bounds of strips (some numbers a strip) are all that the driver sees.
    """
    bounds = ["south", "west", "north", "east"]
    boxes = regions.select("region", *(F.col(c).cast("double").alias(c) for c in bounds)).where("south <= north AND west <= east").distinct()
    places = airborne_positioned(live).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    strips = max(STRIPS, -(-places.count() // PLACES))
    cuts = sorted(set(places.approxQuantile("lon", [k / strips for k in range(1, strips)], 0.1 / strips)))
    strip = lambda lon: F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda cut: cut <= lon))
    touched = boxes.withColumn("strip", F.explode(F.sequence(strip(F.col("west")), strip(F.col("east")))))
    parts = touched.groupBy("strip").agg(F.ceil(F.count("*") / F.lit(BOXES)).cast("int").alias("parts"))
    dealt = touched.join(F.broadcast(parts), "strip").withColumn("part", F.pmod(F.xxhash64("region", *bounds), F.col("parts")).cast("int"))
    placed = places.withColumn("strip", strip(F.col("lon"))).join(F.broadcast(parts), "strip")
    met = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("strip", "part", "lat", "lon", "n")
    sides = met.groupBy("strip", "part").cogroup(dealt.select("strip", "part", "region", *bounds).groupBy("strip", "part"))
    counts = sides.applyInArrow(_counts_within, T.StructType([regions.schema["region"], T.StructField("n", T.LongType())]))
    counted = counts.groupBy("region").agg(F.sum("n").alias("n"))
    every = regions.select("region").distinct().join(counted, "region", "left")
    return every.select("region", F.coalesce("n", F.lit(0)).alias("flight_count")).orderBy(F.desc("flight_count"), "region")


def region_traffic(live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regions by traffic, most first; equal ones in list order."""
    counts = region_counts(live, K.MAP_REGIONS, by)
    return counts.orderBy(*by, F.desc("flight_count"), "ord").drop("ord")


def region_scores(live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regions with their traffic relative to the busiest, 0 to 100 (eight rows)."""
    everything = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    busiest = F.greatest(F.max("flight_count").over(everything), F.lit(1))
    return region_counts(live, K.SCORE_REGIONS, by).select(
        *by, "ord", "region", S.percent_of(F.col("flight_count"), busiest).alias("score")
    )


def region_trend(snapshots: DataFrame) -> DataFrame:
    """Change of each region's count against the cycle before, in percent; null without a base."""
    counts = region_counts(snapshots, K.MAP_REGIONS, ["cycle"])
    previous = F.lag("flight_count").over(W.partitionBy("region").orderBy("cycle"))
    change = F.when(
        F.col("previous") > 0,
        S.percent_of(F.col("flight_count") - F.col("previous"), F.col("previous")),
    )
    return (
        counts.withColumn("previous", previous)
        .withColumn("change_pct", change)
        .withColumn(
            "direction",
            F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat"),
        )
        .drop("ord")
    )


def longitude_density(live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Airborne aircraft in 72 bins of longitude, empty ones with zero; what lies outside is not counted."""
    flying = live.where(~F.col("on_ground") & F.col("lon").isNotNull())
    binned = flying.withColumn("bin", geo.longitude_bin(F.col("lon")))
    counts = (
        binned.where((F.col("bin") >= 0) & (F.col("bin") < K.LONGITUDE_BINS))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("flight_count"))
    )
    bins = F.sequence(F.lit(0).cast("bigint"), F.lit(K.LONGITUDE_BINS - 1).cast("bigint"))
    spine = groups_of(counts, by).select(*by, F.explode(bins).alias("bin"))
    return join_counts(spine, counts, [*by, "bin"], bool(by)).select(
        *by, "bin", F.coalesce("flight_count", F.lit(0)).alias("flight_count")
    )


def density_levels(density: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Height and class of each bin relative to the fullest (72 rows)."""
    everything = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fullest = F.greatest(F.max("flight_count").over(everything), F.lit(1))
    chain = F
    for name, above in K.DENSITY_LEVELS:
        chain = chain.when(F.col("ratio") > above, F.lit(name))
    return density.withColumn("ratio", F.col("flight_count") / fullest).select(
        *by,
        "bin",
        "flight_count",
        "ratio",
        F.greatest(F.col("ratio") * 100, F.lit(2.0)).alias("height_pct"),
        chain.otherwise(F.lit(K.DENSITY_FLOOR)).alias("level"),
    )


def heat_points(live: DataFrame) -> DataFrame:
    return airborne_positioned(live).select("lat", "lon", F.lit(1).alias("weight"))


def density_grid(live: DataFrame, cell: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Weight of the heat points in each cell of a grid in degrees."""
    row: Column = F.floor(F.col("lat") / F.lit(cell)).alias("lat_cell")
    col: Column = F.floor(F.col("lon") / F.lit(cell)).alias("lon_cell")
    points = airborne_positioned(live).withColumn("weight", F.lit(1))
    return points.groupBy(*by, row, col).agg(F.sum("weight").alias("weight"))
