"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywake.llm.common import forget, merging, written

#: Edges that a task flattens at a time.
EDGES = 1 << 18


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: `edges` (u, v; v <= u) that connect the same nodes with flatter trees.

    Every node hands its larger, then its smaller neighbours to the smallest one. Nodes are only grouped with a minimum,
    which combines in the map tasks, and joined with it, which splits a crowded node. Loops (u = u) name nodes and stay.
    """
    proper = edges.where("u <> v")
    both = proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(merging(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.where("u = v")).distinct()
    smaller = large.where("u <> v")
    base = smaller.groupBy("u").agg(F.min("v").alias("m"))
    handed = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    small = smaller.join(merging(base), "u").select(F.explode(handed).alias("e")).select("e.u", "e.v")
    return small.unionByName(large.where("u = v")).distinct()


def flattened(edges: DataFrame, parts: int) -> DataFrame:
    """`edges` (u, v) dealt to `parts`: every node of a part with the smallest node that the part's edges connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                x, y = top(u), top(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if parent:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((list(parent), [top(x) for x in parent]), schema, strict=True)], schema=schema)

    dealt = edges.select("u", "v")
    dealt = dealt.coalesce(1) if parts <= 1 else dealt.repartition(parts, "u", "v")
    return dealt.mapInArrow(run, dealt.schema)


def flatter(edges: DataFrame, count: int) -> DataFrame:
    """`count` `edges` (u, v; v <= u) with flatter trees: flat ones where a task holds all, else by parts and then a `star`."""
    parts = -(-count // EDGES)
    return flattened(edges, parts) if parts <= 1 else star(flattened(edges, parts))


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in `edges` (a, b), which may hold loops and repeats."""
    down = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known = None
    while known != (known := _mark(down)):
        after = written(flatter(down, known[0]), "edges")
        forget(down)
        down = after
        if known[0] <= EDGES:  # flat
            break
    return down.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _mark(edges: DataFrame) -> tuple:
    """Numbers of all and of the proper edges and sums of these: equal when nothing changed."""
    proper = F.col("u") != F.col("v")
    total = lambda *of: F.sum(F.when(proper, F.xxhash64(*of).cast("decimal(38,0)")))
    return tuple(edges.agg(F.count(F.lit(1)), F.count_if(proper), total("u", "v"), total("v", "u")).first())
