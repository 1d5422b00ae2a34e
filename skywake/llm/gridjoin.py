"""Embedding near-dedup by an epsilon grid order join.

Vectors of length one whose cosine is at least ``threshold`` lie within epsilon = sqrt(2 - 2 * threshold). Vectors are laid on the
leading principal directions, sorted by label and by the grid cell (of side epsilon) there, and cut into blocks. Blocks form a
tree of intervals of that order, each with the box around its vectors. Starting from each label's whole sequence, pairs of
intervals are split and joined level by level; a pair whose boxes lie more than epsilon apart is skipped, as projections only
shorten distances. Pairs of blocks that remain are compared in double precision, one pair a cell.

Equal vectors of a label are one class, counted but not compared among themselves. A cell returns for each class how many
vectors it is linked with, and a spanning forest of the links, never the links; components follow from the forests.

Rows whose label is null, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors
of different length don't either. Rows that share an id are rows of their own; a null id is never the smallest.
The principal directions are those of at most ``SAMPLE`` classes; they affect the speed alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import table, written
from skywake.llm.graph import components

THRESHOLD = 0.93
BLOCK, FAN_BITS = 512, 3
AXES, SAMPLE = 4, 4_096
#: Bits of a block's number within its partition of the order.
WITHIN = 24

PLACED = pa.schema([("vkey", pa.string()), ("label", pa.string()), ("dim", pa.int32()), ("copies", pa.int64()), ("unit", pa.list_(pa.float64())),
                    ("at", pa.list_(pa.float64())), ("cell", pa.list_(pa.int64()))])
BLOCKS = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("number", pa.int64()), ("vkeys", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
                    ("units", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
FOUND = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def unit(vector: list[float]) -> np.ndarray | None:
    """The vector at length one, or None without one."""
    x = np.asarray(vector, float)
    most = np.abs(x).max(initial=0)
    if not most or not np.isfinite(most):
        return None
    x = x / most
    return x / np.sqrt(x @ x)


def classes(rows: DataFrame) -> DataFrame:
    """vkey, label, embedding, copies and vec_id (the smallest) of the distinct vectors that can link, and rows keyed alike."""
    return (
        rows.where("vkey IS NOT NULL")
        .groupBy("vkey")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    )


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding with `vkey`, the same for equal vectors of a label, null for what links with nothing."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    # + 0.0 makes one zero of the two; the label's length tells where it ends
    name = F.sha2(F.concat_ws("|", F.length(F.col("label").cast("string")).cast("string"), F.col("label").cast("string"), F.transform(x, lambda c: (c + F.lit(0.0)).cast("string"))), 256)
    return rows.select("vec_id", F.col("label").cast("string").alias("label"), x.alias("embedding"), F.when(fit, name).alias("vkey"))


def directions(held: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """For each vector length in a bounded sample its leading principal directions."""
    by: dict[int, list] = {}
    for row in held.select("vkey", "embedding").orderBy("vkey").limit(SAMPLE).collect():
        found = unit(row.embedding)
        if found is not None:
            by.setdefault(len(found), []).append(found)
    return {dim: np.linalg.svd(np.cov(np.array(rows), rowvar=False).reshape(dim, dim))[0][:, :axes] for dim, rows in by.items() if len(rows) > 1}


def _blocks(ordered: DataFrame, size: int) -> DataFrame:
    """Each partition of the order cut into blocks of one label and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << WITHIN, 0, []

        def close() -> pa.RecordBatch:
            at = np.array([r["at"] for r in held])
            columns = {
                "label": held[0]["label"], "dim": held[0]["dim"], "number": base + number, "vkeys": [r["vkey"] for r in held], "copies": [r["copies"] for r in held],
                "units": np.array([r["unit"] for r in held], float).tobytes(), "low": at.min(axis=0).tolist(), "high": at.max(axis=0).tolist(),
            }
            return pa.RecordBatch.from_pylist([columns], BLOCKS)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == size or (row["label"], row["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield close()
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield close()

    return ordered.mapInArrow(run, "label string, dim int, number long, vkeys array<string>, copies array<long>, units binary, low array<double>, high array<double>")


def _near(a: str, b: str, epsilon: float):
    """Whether two boxes are at most epsilon apart, with room for rounding."""
    apart = [F.greatest(F.lit(0.0), F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i], F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i]) for i in range(AXES)]
    gap = sum((x * x for x in apart), F.lit(0.0))
    return gap <= F.lit(epsilon**2 * (1 + 1e-9) + 1e-12)


def interval_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """label, dim, left and right: the numbers of the blocks (left <= right) that aren't provably distant."""
    boxes = blocks.select("label", "dim", "number", "low", "high")
    span = boxes.agg(F.max("number")).first()[0]
    if span is None:
        return boxes.select("label", "dim", F.col("number").alias("left"), F.col("number").alias("right"))
    # numbers without gaps between the partitions' blocks make the tree shallow
    most = boxes.agg(F.max(F.col("number").bitwiseAND((1 << WITHIN) - 1))).first()[0]
    bits = max(1, int(most).bit_length())
    short = F.shiftleft(F.shiftright("number", WITHIN), bits) + F.col("number").bitwiseAND((1 << WITHIN) - 1)
    boxes = boxes.withColumn("node", short)
    levels = max(1, -(-(((int(span) >> WITHIN) << bits) + int(most) + 1).bit_length() // FAN_BITS))

    def level(up: int) -> DataFrame:
        key = F.shiftright("node", up * FAN_BITS)
        bound = [F.array(*(f(F.col(side)[i]) for i in range(AXES))).alias(side) for side, f in (("low", F.min), ("high", F.max))]
        return boxes.groupBy("label", "dim", key.alias("node")).agg(*bound)

    pairs = level(levels).select("label", "dim", F.col("node").alias("left"), F.col("node").alias("right"))
    for up in range(levels - 1, -1, -1):
        nodes = (boxes.select("label", "dim", "node", "low", "high", "number") if up == 0 else level(up)).withColumn("parent", F.shiftright("node", FAN_BITS))
        a, b = nodes.alias("a"), nodes.alias("b")
        same = lambda s: (F.col("p.label") == F.col(f"{s}.label")) & (F.col("p.dim") == F.col(f"{s}.dim"))
        joined = (
            pairs.alias("p")
            .join(a, same("a") & (F.col("p.left") == F.col("a.parent")))
            .join(b, same("b") & (F.col("p.right") == F.col("b.parent")) & (F.col("a.node") <= F.col("b.node")) & _near("a", "b", epsilon))
        )
        end = "number" if up == 0 else "node"
        pairs = joined.select("p.label", "p.dim", F.col(f"a.{end}").alias("left"), F.col(f"b.{end}").alias("right"))
    return pairs


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of `a` and `b` (vectors of length one) have a cosine of at least `threshold`.

    Products within rounding of the threshold are summed again with a correctly rounded sum.
    """
    cosine = a @ b.T
    found = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-13), strict=True):
        x, y = a[i], b[j]
        found[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= threshold
    return found


def forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: each row or column (numbered behind the rows) to the smallest of its tree."""
    rows, columns = found.shape
    left, right = np.nonzero(found)
    label = np.arange(rows + columns)
    while True:
        least = np.minimum(label[left], label[rows + right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, rows + right, least)
        new = new[new]
        if (new == label).all():
            return [(int(i), int(label[i])) for i in range(rows + columns) if label[i] != i]
        label = new


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `rows` (vec_id, embedding, label)."""
    named = keyed(rows)
    held = written(classes(named), "classes")
    axes = directions(held)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = unit(row["embedding"])
                at = np.zeros(AXES)
                if len(x) in axes:
                    found = x @ axes[len(x)]
                    at[: len(found)] = found
                cell = np.floor(at / epsilon).astype(int).tolist() if epsilon else np.zeros(AXES, int).tolist()
                out.append({"vkey": row["vkey"], "label": row["label"], "dim": len(x), "copies": row["copies"], "unit": x.tolist(), "at": at.tolist(), "cell": cell})
            yield pa.RecordBatch.from_pylist(out, PLACED)

    schema = "vkey string, label string, dim int, copies long, unit array<double>, at array<double>, cell array<long>"
    order = ["label", "dim", "cell", "vkey"]
    parts = max(1, -(-held.count() // (block * 4)))
    placed = written(held.select("vkey", "label", "embedding", "copies").mapInArrow(place, schema), "placed")
    blocks = written(_blocks(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order), block), "blocks")
    pairs = interval_pairs(blocks, epsilon)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                row = {n: batch.column(n)[number].as_py() for n in batch.schema.names}
                a, b = (np.frombuffer(row[f"{s}_units"], float).reshape(-1, row["dim"]) for s in ("a", "b"))
                found, same = links(a, b, threshold), row["left"] == row["right"]
                names = row["a_vkeys"] + row["b_vkeys"]
                if same:
                    np.fill_diagonal(found, False)
                counts = found @ np.array(row["b_copies"]), found.T @ np.array(row["a_copies"])
                sums = counts[0].tolist() + ([0] * len(b) if same else counts[1].tolist())
                out = [(names[i], None, n) for i, n in enumerate(sums) if n]
                trees = forest(found if not same else found | found.T)
                out += [(names[i], names[j], 0) for i, j in trees if names[i] != names[j]]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    def side(name: str) -> DataFrame:
        return blocks.select("label", "dim", F.col("number").alias("left" if name == "a" else "right"), *(F.col(c).alias(f"{name}_{c}") for c in ("vkeys", "copies", "units")))

    cells = pairs.join(side("a"), ["label", "dim", "left"]).join(side("b"), ["label", "dim", "right"])
    cells = cells.select("dim", "left", "right", *(f"{s}_{c}" for s in ("a", "b") for c in ("vkeys", "copies", "units")))
    found = written(cells.mapInArrow(compare, "a string, b string, n long"), "links")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("vkey")).agg(F.sum("n").alias("n"))
    tree = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vkey")
    part = held.select("vkey", "copies", "vec_id").join(linked, "vkey", "left").join(tree, "vkey", "left").withColumn("component", F.coalesce("component", "vkey"))
    first = part.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    answer = part.join(first, "component").select(
        "vkey", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("component_id")
    )
    return named.select("vec_id", "vkey").join(answer, "vkey", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with the links to others of their label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS fit
  FROM embeddings),
v AS (SELECT n, label, x, sqrt(list_dot_product(x, x)) AS size FROM r WHERE fit),
p AS (
  SELECT a.n AS x, b.n AS y FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / a.size / b.size >= 0.93),
reached AS (SELECT n, n AS m FROM r UNION SELECT o.n, p.y FROM reached o JOIN p ON p.x = o.m),
c AS (SELECT o.n, min(r.vec_id) AS component_id FROM reached o JOIN r ON r.n = o.m GROUP BY o.n),
k AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN c USING (n) LEFT JOIN k ON k.x = r.n
"""
