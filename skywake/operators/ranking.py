"""Top rows, pages and evenly spaced samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skywake.functions import geo
from skywake.session import shared_dir


def top_rows(rows: DataFrame, order: Sequence[Column | str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """The first rows in an order, overall or for each value of ``by``."""
    if by:
        return top_per(rows, by, order, limit)
    return rows.orderBy(*order).limit(limit)


def top_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first rows of each group; Spark applies a limit up to 1,000 in each map task before the shuffle."""
    window = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit).drop("_rank")


def groups_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups a spine is built for; one row without columns of use if there is no grouping."""
    return counts.select(*by).distinct() if by else counts.sparkSession.range(1)


def join_counts(spine: DataFrame, counts: DataFrame, keys: Sequence[str], grouped: bool) -> DataFrame:
    """Left join of counts to their spine. Without groups the counts have at most a row per entry: broadcast."""
    return spine.join(counts if grouped else F.broadcast(counts), list(keys), "left")


def page_of(rows: DataFrame, order: Sequence[str], page: int = 1, size: int = 20) -> DataFrame:
    """One page of the rows in order of unique keys, with its number and the number of pages (at least one) (an action).

    The keys are numbered by a distributed sort, so a deep page is no more work than the first and no task merges the rows
    before it. To go through pages one after the other, ``page_after`` sorts nothing.
    """
    first = (page - 1) * size
    indexed = row_indexes(rows, order)
    wanted = indexed.where((F.col("row_index") >= first) & (F.col("row_index") < first + size))
    pages = rows.agg(F.greatest(F.ceil(F.count("*") / F.lit(size)), F.lit(1)).alias("pages")).scalar()
    same = F.lit(True)
    for key in order:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"w.{key}"))
    shown = rows.alias("r").join(wanted.alias("w"), same).orderBy("w.row_index").select("r.*")
    return shown.withColumn("page", F.lit(page)).withColumn("total_pages", pages)


def page_after(rows: DataFrame, keys: Sequence[str | tuple[str, bool]], after: Sequence | None = None, size: int = 20) -> DataFrame:
    """The page that follows the row with the given key values.

    Unlike an offset, it costs the same at any depth: the rows before it are filtered out in the scan. A key is a column
    name, ascending, or (name, descending). Nulls stand where Spark's order has them: first ascending, last descending.
    """
    named = [(key, False) if isinstance(key, str) else key for key in keys]
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (key, descending), value in zip(named, after, strict=True):
            column, given = F.col(key), F.lit(value).cast(rows.schema[key].dataType)
            if descending:
                later = F.lit(False) if value is None else column.isNull() | (column < given)
            else:
                later = column.isNotNull() if value is None else F.coalesce(column > given, F.lit(False))
            beyond = beyond | (equal & later)
            equal = equal & column.eqNullSafe(given)
        rows = rows.where(beyond)
    return rows.orderBy(*(F.desc(key) if descending else F.asc(key) for key, descending in named)).limit(size)


def row_indexes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The unique ``keys`` of all rows with their position ``row_index`` in key order and ``row_count`` (an action).

    One window over all rows would pull them into one task. Instead the keys alone are range-partitioned
    and sorted, and each partition's offset is the sum of the counts before it. The sorted keys are
    checkpointed in the shared folder: counts and positions then come from the same partitions, even if an
    executor is lost in between.
    """
    shared_dir(rows.sparkSession)
    place = F.monotonically_increasing_id()
    placed = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place)
    placed = placed.checkpoint().withColumn("_part", F.shiftright("_place", 33))
    in_part = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the sorted keys: bounded by the number of shuffle partitions.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    everything = F.sum("_rows").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"), everything.alias("row_count"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *keys, (F.col("_offset") + in_part).alias("row_index"), "row_count"
    )


def systematic_sample(rows: DataFrame, limit: int, keys: Sequence[str] = ("icao24",)) -> DataFrame:
    """All rows if there are at most ``limit``, else ``limit`` rows evenly spaced in key order (an action)."""
    return rows.join(sampled_keys(row_indexes(rows, keys), limit).select(*keys), list(keys), "left_semi")


def sampled_keys(indexed: DataFrame, limit: int) -> DataFrame:
    """The rows of ``row_indexes`` that a sample of ``limit`` takes.

    Row ``r`` of ``n`` stays if some sample number ``i`` has ``floor(i * n / limit) = r``; in whole numbers,
    the first ``i`` with ``i * n >= r * limit`` must lie below ``(r + 1) * limit / n``.
    """
    first = F.expr(f"(row_index * {limit} + row_count - 1) div row_count")
    return indexed.where(first * F.col("row_count") < (F.col("row_index") + 1) * limit)


def zoom_sample(
    rows: DataFrame, zoom: int, bounds: tuple[float, float, float, float], keys: Sequence[str] = ("icao24",)
) -> DataFrame:
    """What the map draws of the rows with a position: a sample when zoomed out, all in view when zoomed in."""
    return zoom_samples(rows, [zoom], bounds, keys).drop("zoom")


def zoom_samples(
    rows: DataFrame, zooms: Sequence[int], bounds: tuple[float, float, float, float], keys: Sequence[str] = ("icao24",)
) -> DataFrame:
    """The same for several zooms, with the zoom; the rows are numbered once for all samples."""
    placed = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    parts = [placed.where(geo.in_box(F.col("lat"), F.col("lon"), *bounds)).withColumn("zoom", F.lit(z)) for z in zooms if z >= 7]
    far = [z for z in zooms if z < 7]
    if far:
        indexed = row_indexes(placed, keys)
        chosen = [sampled_keys(indexed, 5000 if z < 4 else 10000).select(*keys, F.lit(z).alias("zoom")) for z in far]
        parts.append(placed.join(reduce(DataFrame.unionByName, chosen), list(keys)))
    return reduce(DataFrame.unionByName, parts)
