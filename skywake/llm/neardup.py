"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's shingles are its runs of ``width`` words (letters, digits and _, in lower case), weighted by how often they occur; a
text with fewer words has them all as its one shingle. Each shingle is a Poisson process of its weight: arrivals fall on random
registers, a register keeps the shingle of its earliest arrival, and a shingle stops when its time has passed the latest
register. Two documents agree in a register with the probability that is their probability Jaccard similarity.

1. Documents with equal word sequences are one class; classes, not copies, are compared.
2. Registers are banded. In every band bucket the class that meets most others in all its buckets is compared with all others
   of other components, by an estimate from one bit of each register first, then exactly, and leaves the bucket; then the next two.
   Buckets that are down to one component are done. What is left, texts that are alike but not alike enough, is clustered by common
   buckets, and a cluster's members are compared block against block. So every pair of classes that meet in a bucket is compared
   or already connected; pairs within a group are never listed and never capped.
3. Classes are components of the links.

At a similarity of 0.8 a pair meets in no bucket with probability 5e-8, and each estimate rejects it with one of less than 1e-7.

Null texts and texts without a word link with nothing: each is a class of its own. Rows that share a doc_id are rows of their own;
a null id is never a class's id unless the class has no other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywake.llm.common import forget, merging, slices, table, written
from skywake.llm.graph import components, flatter

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Classes of a bucket that are compared with all others, in turn.
STARS = (1, 2)
#: Members and bytes of a block of what is left.
BLOCK, BYTES = 128, 1 << 22
#: Pairs whose registers agree less than this below the similarity aren't verified.
SLACK = 0.2

WORD = re.compile(r"\w+")
MARKED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary()),
                    ("low", pa.int64()), ("high", pa.int64())])
BODIES = pa.schema([("num", pa.int64()), ("body", pa.binary())])

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str], width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the runs of `width` words, in order."""
    if not tokens:
        return np.zeros(0, np.uint64)
    import pandas as pd  # in the tasks alone, the driver has no use for it

    codes, distinct = pd.factorize(np.array(tokens, dtype=object))
    hashes = pd.util.hash_array(distinct, categorize=False)[codes]
    width = min(width, len(tokens))
    n = len(tokens) - width + 1
    found = np.full(n, width, np.uint64)
    for i in range(width):
        found = mix(found * _A + hashes[i : i + n])
    return found


def registers(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, docs: int, count: int = REGISTERS) -> np.ndarray:
    """The shingle each register of each document keeps (`docs` rows), from shingles `hashes` of document `doc` with `weights`."""
    best, kept = np.full(docs * count, np.inf), np.zeros(docs * count, np.uint64)
    doc, hashes, weights = doc.copy(), hashes.copy(), weights.astype(float)
    time, arrival = np.zeros(len(hashes)), 0
    while len(hashes):
        several = int(min(64, max(1, 8_192 // len(hashes))))
        number = np.arange(arrival, arrival + several, dtype=np.uint64)
        arrival += several
        drawn = mix(hashes[:, None] + (number * np.uint64(2) + np.uint64(1)) * _A)
        where = (mix(drawn + _A) % np.uint64(count)).astype(np.int64)
        wait = -np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        at = time[:, None] + np.cumsum(wait, axis=1) / weights[:, None]
        spot = doc[:, None] * count + where
        before = best[spot] > at
        spots, times = spot[before], at[before]
        np.minimum.at(best, spots, times)
        won = best[spots] == times
        kept[spots[won]] = np.broadcast_to(hashes[:, None], at.shape)[before][won]
        time = at[:, -1]
        on = time < best.reshape(docs, count).max(axis=1)[doc]  # a shingle past the latest register is done
        doc, hashes, weights, time = doc[on], hashes[on], weights[on], time[on]
    return kept.reshape(docs, count)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The probability Jaccard similarity of two multisets of hashes."""
    return weighted_jaccard(np.unique(a, return_counts=True), np.unique(b, return_counts=True))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), of sorted distinct hashes and their counts."""
    (left, n), (right, m) = a, b
    both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if n.max() == 1 and m.max() == 1:
        return len(both) / (len(left) + len(right) - len(both))
    x, y = n[i].astype(float), m[j].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # j with a smaller or equal ratio count by a, the others by b; shingles of one side alone likewise
    upto = np.searchsorted(ratio, ratio, side="right")
    sums_x, sums_y = np.concatenate([[0], x.cumsum()]), np.concatenate([[0], y.cumsum()])
    alone_x, alone_y = n.sum() - x.sum(), m.sum() - y.sum()
    total = (alone_x + sums_x[upto]) / x + (alone_y + sums_y[-1] - sums_y[upto]) / y
    return float((1 / total).sum())


def mark(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, tag (a hash of the text), digest of the words, bands, registers (16 bits of each), low and high (a bit of each) of every row; null digest without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            tokens = [words(t) for t in part["text"]]
            digests = [hashlib.md5(" ".join(t).encode(), usedforsecurity=False).digest() if t else None for t in tokens]
            found = [np.unique(shingles(t, width), return_counts=True) for t in tokens]
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            held = registers(doc, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(found)) if len(doc) else None
            bands, short, low, high = ([None] * len(found) for _ in range(4))
            if held is not None:
                banded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _A, (len(found), BANDS)).copy()
                for row in range(ROWS):
                    banded = mix(banded + held[:, row::ROWS] * _A)
                bits = np.packbits((held & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                for number, t in enumerate(tokens):
                    if t:
                        low[number], high[number] = bits[number].tolist()
                        bands[number] = banded[number].astype(np.int64).tolist()
                        short[number] = (held[number] >> np.uint64(48)).astype("<u2").tobytes()
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((part["doc_id"], part["tag"], digests, bands, short, low, high), MARKED, strict=True)], schema=MARKED)

    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return tagged.mapInArrow(run, "doc_id long, tag long, digest binary, bands array<long>, registers binary, low long, high long")


def _bodies(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """num and body (shingles as 64-bit hashes) of the classes `wanted` (num, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            out = []
            for num, digest, text in zip(part["num"], part["digest"], part["text"], strict=True):
                tokens = words(text)
                if hashlib.md5(" ".join(tokens).encode(), usedforsecurity=False).digest() == digest:  # ids can repeat
                    out.append((num, np.sort(shingles(tokens, width)).tobytes()))
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(BODIES)], schema=BODIES)

    keyed = wanted.select("num", "digest", F.col("doc_id").alias("of"))
    both = docs.select("doc_id", "text").join(merging(keyed), F.col("doc_id").eqNullSafe(F.col("of"))).select("num", "digest", "text")
    # rows that repeat give the same body again
    return both.mapInArrow(run, "num long, body binary").groupBy("num").agg(F.first("body").alias("body"))


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            same = [
                probability_jaccard(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) >= similarity - 1e-12
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    one = pairs.join(merging(bodies.select(F.col("num").alias("b"), F.col("body").alias("y"))), "b")
    both = one.join(merging(bodies.select(F.col("num").alias("a"), F.col("body").alias("x"))), "a").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


def _packed(members: DataFrame) -> DataFrame:
    """`members` (cluster, num, component, registers, body) in blocks of about `BLOCK` members or `BYTES` bytes of a cluster."""
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("body")) / BYTES)).alias("blocks"))
    dealt = members.join(merging(size), "cluster").withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")))
    held = F.collect_list(F.struct("num", "component", "registers", "body"))
    return dealt.groupBy("cluster", "blocks", "block").agg(held.alias("held"))


def _compared(members: DataFrame, similarity: float) -> DataFrame:
    """u and v (v < u): enough links among `members` of a cluster to connect all that are linked.

    Blocks of a cluster meet block by block, each pair in a cell of its own, so no pair of members is ever a row. A cell skips
    pairs it knows to be connected, takes the estimate from the registers first, and computes the likely ones.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = [row["x"], row["y"]] if row["block"] != row["other"] else [row["x"], row["x"]]
                marks = [np.array([np.frombuffer(m["registers"], "<u2") for m in side]) for side in sides]
                held = [[np.unique(np.frombuffer(m["body"], np.uint64), return_counts=True) for m in side] for side in sides]
                parent = {m["component"]: m["component"] for side in sides for m in side}

                def top(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                agree = np.array([(marks[1] == one).mean(axis=1) for one in marks[0]])
                near = np.argwhere(agree >= similarity - SLACK)
                out = []
                for i, k in near[np.argsort(-agree[near[:, 0], near[:, 1]], kind="stable")].tolist():
                    if row["block"] == row["other"] and i >= k:
                        continue
                    a, b = sides[0][i], sides[1][k]
                    x, y = top(a["component"]), top(b["component"])
                    if x != y and weighted_jaccard(held[0][i], held[1][k]) >= similarity - 1e-12:
                        parent[max(x, y)] = min(x, y)
                        out.append((max(a["num"], b["num"]), min(a["num"], b["num"])))
                yield pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    blocks = written(_packed(members), "blocks")
    cells = blocks.select("cluster", "block", F.col("held").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    others = blocks.select("cluster", F.col("block").alias("other"), F.col("held").alias("y"))
    return cells.join(merging(others), ["cluster", "other"]).select("block", "other", "x", "y").mapInArrow(compare, "u long, v long")


def most_different(similarity: float) -> int:
    """How many of the registers' bits may differ for a pair to be verified: six standard deviations above what is expected."""
    odds = (1 - similarity) / 2  # half of the registers that differ have the same bit
    return int(REGISTERS * odds + 6 * (REGISTERS * odds * (1 - odds)) ** 0.5)


ENTRY = ["band", "num", "weight", "low", "high"]


def _open(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """`entries` with their component so far, of the buckets that hold several.

    Of many links, components come from one step of the tree, so members of one may be told apart still, which only costs comparisons.
    """
    labels = tree.groupBy(F.col("u").alias("num")).agg(F.min("v").alias("component"))
    placed = entries.select(*ENTRY).join(merging(labels), "num", "left").withColumn("component", F.coalesce("component", "num"))
    several = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band")
    return placed.join(merging(several), "band")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, tag (a hash of the text), class_id (the smallest doc_id of the class) and kept for every row of `docs` (doc_id, text)."""
    marks = written(mark(docs, width), "marks")
    one = marks.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("bands", "registers", "low", "high")))
    held = written(one.withColumn("num", F.monotonically_increasing_id()), "classes")
    met = held.select("num", "low", "high", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = written(met.join(merging(shared), "band"), "entries")
    # the class that meets most others comes first: copies of one text meet it more than each other
    weight = sized.groupBy("num").agg((-F.sum("n")).alias("weight"))
    entries = written(sized.join(merging(weight), "num").select(*ENTRY), "entries")
    forget(sized)
    wanted = held.join(merging(entries.select("num").distinct()), "num")
    bodies = written(_bodies(docs, wanted, width), "bodies")
    tree, left = None, entries.withColumn("component", F.col("num"))  # what is linked so far, what is left to compare
    for centres in STARS:
        left = left if tree is None else written(_open(left, tree), "entries")
        rank = F.row_number().over(Window.partitionBy("band").orderBy("weight", "num"))
        chosen = left.withColumn("place", rank).where(F.col("place") <= centres).drop("place")
        pairs = (
            chosen.alias("c")
            .join(merging(left.alias("o")), (F.col("c.band") == F.col("o.band")) & (F.col("c.component") != F.col("o.component")))
            .where(F.struct("c.weight", "c.num") < F.struct("o.weight", "o.num"))
            .where(F.bit_count(F.col("c.low").bitwiseXOR(F.col("o.low"))) + F.bit_count(F.col("c.high").bitwiseXOR(F.col("o.high"))) <= most_different(similarity))
            .select(F.col("c.num").alias("a"), F.col("o.num").alias("b"))
            .distinct()
        )
        linked = written(_verified(pairs, bodies, similarity).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
        edges = linked if tree is None else tree.unionByName(linked)
        tree = written(flatter(edges, edges.count()), "tree")
        passed = chosen.groupBy("band").agg(F.max(F.struct("weight", "num")).alias("upto"))
        left = left.join(merging(passed), "band").where(F.struct("weight", "num") > F.col("upto")).select(*ENTRY)
    rest = written(_open(left, tree), "entries")
    if not rest.isEmpty():
        first = rest.groupBy("band").agg(F.min("num").alias("b"))
        clusters = components(rest.select("band", F.col("num").alias("a")).join(merging(first), "band").select("a", "b")).select(F.col("node").alias("num"), F.col("component").alias("cluster"))
        named = rest.groupBy("num").agg(F.min("component").alias("component")).join(merging(clusters), "num")
        members = named.join(merging(held.select("num", "registers")), "num").join(merging(bodies), "num")
        tree = tree.unionByName(written(_compared(members, similarity), "links"))
    parts = components(tree.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("node", "num")
    tagged = held.select("digest", "doc_id", "num").join(merging(parts), "num", "left").withColumn("component", F.coalesce("component", "num"))
    ids = tagged.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = tagged.join(merging(ids), "component").select("digest", "class_id")
    return marks.select("doc_id", "tag", "digest").join(merging(named), "digest", "left").select(
        "doc_id", "tag", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("doc_id").eqNullSafe(F.coalesce("class_id", "doc_id")).alias("kept")
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near duplicates they are in."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tag")
