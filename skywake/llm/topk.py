"""Exact top-k search by distributed histogram selection.

Vectors and queries are packed into bounded blocks; every pair of blocks is scored in a cell of its own, so no task holds more
than two blocks. A pass over all cells counts each query's scores in the bins of its current score range; the bin with the
k-th largest becomes the next range, until it is one score wide. A last pass returns what lies above that score, and of the ties
at it those with the smallest ids. A cell never returns more than k bins or k ties a query: below its own k largest scores
the k-th of all can't lie.

Every row is a vector of its own, also where rows share an id or are equal: a query's candidates are all rows but itself, and a query
that repeats is answered each time. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id,
nor vectors with a component so large that an inner product might not fit 64 bits (in integers, the root of 2^61 over the number of
components). Only vectors of the same length are compared. A query without enough candidates returns all of them. Scores are
integers; they are computed in floating point only where every partial sum is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywake.llm.common import forget, table, written

K, BINS = 5, 1_024
VECTORS, QUERIES = 1_024, 512

CELL = ["dim", "block", "qblock"]
HISTOGRAM = "query long, bin long, n long"
FOUND = "query long, query_id long, row long, vec_id long, score long"


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id and v, floor(scale * component), of the vectors that take part."""
    x = F.col("embedding")
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(x), F.lit(1)))) - 1
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) <= most))
    chosen = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & fit)
    return chosen.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """`rows` with their vector length `dim`, a block number `name` and the number of blocks of that length, of about `size` rows each."""
    sized = rows.withColumn("dim", F.size("v"))
    lengths = sized.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"{name}s"))
    return sized.join(lengths, "dim").withColumn(name, F.pmod(F.xxhash64("row"), F.col(f"{name}s")))


def packed(rows: DataFrame, name: str, *also: str) -> DataFrame:
    """One row per block of dealt rows: rows, ids, v (the vectors one behind the other) and the columns `also`, each as an array."""
    return (
        rows.groupBy("dim", f"{name}s", name)
        .agg(F.collect_list(F.struct("row", "vec_id", "v", *also)).alias("held"))
        .select("dim", f"{name}s", name, F.col("held.row").alias("rows"), F.col("held.vec_id").alias("ids"), F.flatten("held.v").alias("v"), *(F.col(f"held.{c}").alias(c) for c in also))
    )


def _matrix(values: list, dim: int, rows: int) -> np.ndarray:
    return np.asarray(values, np.int64).reshape(rows, dim)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**52:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def _cells(data: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block of `data` with each block of `asked` that has vectors of the same length, one row a cell."""
    numbers = data.select("dim", "blocks").distinct()
    asks = asked.select("dim", "qblocks").distinct()
    left = data.join(asks, "dim").withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qblocks") - 1))).drop("qblocks", "blocks")
    right = asked.join(numbers, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("qblocks", "blocks")
    return left.join(right.withColumnsRenamed({"rows": "qrows", "ids": "qids", "v": "qv"}), CELL).drop("block", "qblock")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for place in range(batch.num_rows):
            row = {name: batch.column(name)[place].values for name in batch.schema.names if name != "dim"}
            row = {name: values.to_numpy(zero_copy_only=False) for name, values in row.items()}
            dim = batch.column("dim")[place].as_py()
            scores = _scores(_matrix(row["qv"], dim, len(row["qids"])), _matrix(row["v"], dim, len(row["ids"])))
            yield row, scores, row["qrows"][:, None] != row["rows"][None, :]


def _count(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, scores, other in _read(batches):
            low, width, need = row["low"][:, None], row["width"][:, None], row["need"]
            spots = (scores - low) // width
            inside = other & (spots >= 0) & (spots < bins)
            where, _ = np.nonzero(inside)
            n = np.bincount(where * bins + spots[inside], minlength=len(need) * bins).reshape(len(need), bins)
            above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
            query, spot = np.nonzero((n > 0) & (above < need[:, None]))
            yield pa.record_batch([pa.array(row["qrows"][query]), pa.array(spot.astype(np.int64)), pa.array(n[query, spot].astype(np.int64))],
                                  names=["query", "bin", "n"])

    return run


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, scores, other in _read(batches):
        low, need = row["low"], row["need"]
        query, place = np.nonzero(other & (scores > low[:, None]))
        order = np.lexsort((row["rows"], row["ids"]))
        ties = (other & (scores == low[:, None]))[:, order]
        also, tied = np.nonzero(ties & (ties.cumsum(axis=1) <= need[:, None]))
        query, place = np.concatenate([query, also]), np.concatenate([place, order[tied]])
        columns = row["qrows"][query], row["qids"][query], row["rows"][place], row["ids"][place], scores[query, place]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["query", "query_id", "row", "vec_id", "score"])


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = 256, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best of all other vectors for every vector of `rows` (vec_id, embedding) where `is_query`."""
    held = written(integers(rows, scale), "vectors")
    data = written(packed(dealt(held, VECTORS, "block"), "block"), "blocks")
    # no score leaves the range that the largest components allow
    largest = F.aggregate("v", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.abs(c)))
    span = held.select(F.size("v").alias("dim"), largest.alias("m")).groupBy("dim").agg(F.max("m").alias("m"))
    widest = span.select(F.max(F.col("dim") * F.col("m").cast("double") * F.col("m"))).first()[0]
    bound = int(widest or 0) + 1
    passes = 1
    while bins**passes < 2 * bound + 1:
        passes += 1
    state = dealt(held.where(is_query), QUERIES, "qblock").select(
        "dim", "qblocks", "qblock", "row", "vec_id", "v", F.lit(-bound).cast("long").alias("low"),
        F.lit(bins ** (passes - 1)).cast("long").alias("width"), F.lit(k).cast("long").alias("need"),
    )
    asks = written(packed(state, "qblock", "low", "width", "need"), "queries")
    state = written(state, "state")
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    for _ in range(passes):
        counted = _cells(data, asks).mapInArrow(_count(bins), HISTOGRAM).groupBy("query", "bin").agg(F.sum("n").alias("n"))
        reached = counted.withColumn("upto", F.sum("n").over(down)).join(state.select(F.col("row").alias("query"), "need"), "query")
        # the bin of the k-th; a query without k candidates has none and stays below all of them
        hit = reached.where("upto >= need").groupBy("query").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("hit"))
        after = state.join(hit, F.col("row") == F.col("query"), "left").select(
            "dim", "qblocks", "qblock", "row", "vec_id", "v",
            F.when(F.col("hit").isNull(), F.least("low", F.lit(-bound - 1))).otherwise(F.col("low") + F.col("hit.bin") * F.col("width")).alias("low"),
            F.greatest(F.lit(1).cast("long"), F.floor(F.col("width") / bins)).alias("width"),
            (F.col("need") - F.coalesce(F.col("hit.above"), F.lit(0))).alias("need"),
        )
        before = state, asks
        state = written(after, "state")
        asks = written(packed(state, "qblock", "low", "width", "need"), "queries")
        forget(*before)
    found = _cells(data, asks).mapInArrow(_take, FOUND)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)
      OR abs(256 * CAST(x AS DOUBLE)) > floor(sqrt(2305843009213693952e0 / greatest(len(embedding), 1))) - 1)) = 0),
q AS (SELECT n AS query, vec_id AS query_id, v AS qv FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT query, query_id, n, vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * qv[i])), 0) AS BIGINT) AS score
  FROM q JOIN v ON n <> query AND len(v) = len(qv)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, n) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
