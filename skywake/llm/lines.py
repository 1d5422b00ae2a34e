"""Line dedup that can be taken back: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case; keys shorter than ``min_chars`` code points
are not indexed. The index is three tables in the shared folder:

* `refs`: one row per key and document holding it, the references themselves;
* `counts`: per key its number of documents and its largest doc_id;
* `filters`: per shard of keys a cuckoo filter of their fingerprints.

`insert` asks the filters which keys of a batch may be known. Only those meet the exact tables; the others are new and are
appended. `delete` takes documents' references out, and keys without any leave the counts and their filters, so an index
after insert and delete answers as if the documents had never been there. The number of shards follows the number of keys;
when it has to grow, the filters are built anew from the counts.

Null and empty texts are one empty line. Rows that share a doc_id (also a null one, which counts as the smallest) are one
document for the counts, and each loses the same keys. Rows that repeat stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import batch_of, slices, table, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that documents are inserted in, and parts of which `op7_line_dedup` delivers one again.
BATCHES, DELIVERIES = 2, 16
#: Keys a shard's filter holds when the number of shards is chosen; it grows once there are twice as many.
SHARD_KEYS = 20_000
STRIP = " \t\n\x0b\x0c\r"

KEYED = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])
SEEN = pa.schema([("key", pa.binary()), ("seen", pa.bool_())])
FILTERS = pa.schema([("shard", pa.int32()), ("slots", pa.binary()), ("spare", pa.list_(pa.binary()))])


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the line's key, or None where it is too short. bytes.lower() changes A-Z alone."""
    stripped = line.strip(STRIP)
    return hashlib.md5(stripped.encode().lower(), usedforsecurity=False).digest() if len(stripped) >= min_chars else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is free. Keys that find no place wait in `spare`, whole."""

    def __init__(self, buckets: int = 0, slots: np.ndarray | None = None, spare: list[bytes] | None = None):
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots
        self.spare = set(spare or [])
        self.mask = len(self.slots) - 1

    @classmethod
    def room_for(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, (keys * 10 // 27).bit_length()))  # at most two thirds full

    def places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, first ^ self.jump(mark)

    def jump(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 5 | 1) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self.places(key)
        return mark in self.slots[first].tolist() or mark in self.slots[second].tolist() or key in self.spare

    def add(self, key: bytes) -> None:
        mark, first, second = self.places(key)
        for place in (first, second):
            row = self.slots[place].tolist()
            if 0 in row:
                self.slots[place, row.index(0)] = mark
                return
        moves, place = [], second
        for turn in range(200):  # move others on
            slot = (turn + place) & 3
            moved = int(self.slots[place, slot])
            moves.append((place, slot, moved))
            self.slots[place, slot] = mark
            mark, place = moved, place ^ self.jump(moved)
            row = self.slots[place].tolist()
            if 0 in row:
                self.slots[place, row.index(0)] = mark
                return
        for place, slot, moved in reversed(moves):  # no way: put all back
            self.slots[place, slot] = moved
        self.spare.add(key)

    def remove(self, key: bytes) -> None:
        """Only for keys that were added."""
        if key in self.spare:
            self.spare.remove(key)
            return
        mark, first, second = self.places(key)
        for place in (first, second):
            row = self.slots[place].tolist()
            if mark in row:
                self.slots[place, row.index(mark)] = 0
                return


def _opened(rows: pa.Table) -> CuckooFilter | None:
    for row in rows.to_pylist():
        return CuckooFilter(slots=np.frombuffer(row["slots"], np.uint16).reshape(-1, 4).copy(), spare=row["spare"])
    return None


def _stored(shard: int, held: CuckooFilter) -> pa.Table:
    return pa.table({"shard": [shard], "slots": [held.slots.tobytes()], "spare": [sorted(held.spare)]}, schema=FILTERS)


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key and doc_id, once each, of all lines of `docs` that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, ids = [], []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                found = {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}
                keys += found
                ids += [doc_id] * len(found)
            yield batch_of(KEYED, key=keys, doc_id=ids)

    return docs.select("doc_id", "text").mapInArrow(run, "key binary, doc_id long").distinct()


@dataclass(frozen=True)
class LineIndex:
    """An index of lines; insert and delete give the next one and leave this one readable."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = 0
    min_chars: int = MIN_CHARS

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = MIN_CHARS) -> LineIndex:
        def frame(schema: str) -> DataFrame:
            return spark.createDataFrame([], schema)

        return cls(
            frame("key binary, doc_id long"),
            frame("key binary, n_docs long, last_doc long"),
            frame("shard int, slots binary, spare array<binary>"),
            0,
            min_chars,
        )

    def _shard(self, shards: int | None = None):
        return F.pmod(F.xxhash64("key"), F.lit(max(1, shards or self.shards))).cast("int")

    def _seen(self, keys: DataFrame) -> DataFrame:
        """`keys` (one row per key) with `seen`, whether the filters may hold it."""

        def look(asked: pa.Table, stored: pa.Table) -> pa.Table:
            held = _opened(stored)
            found = asked["key"].to_pylist()
            return pa.table({"key": found, "seen": [held is not None and k in held for k in found]}, schema=SEEN)

        asked = keys.select("key", self._shard().alias("shard"))
        return asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(look, "key binary, seen boolean")

    def _filters(self, counts: DataFrame, shards: int, gone: DataFrame | None, new: DataFrame) -> DataFrame:
        """The next filters: built anew where the number of shards changes, else with the `gone` and `new` keys."""
        target = SHARD_KEYS * 2

        if shards != self.shards:

            def build(group: pa.Table) -> pa.Table:
                keys = group["key"].to_pylist()
                held = CuckooFilter.room_for(max(target, len(keys)))
                for key in keys:
                    held.add(key)
                return _stored(group["shard"][0].as_py(), held)

            keyed = counts.select("key", self._shard(shards).alias("shard"))
            return keyed.groupBy("shard").applyInArrow(build, self.filters.schema)

        def change(changes: pa.Table, stored: pa.Table) -> pa.Table:
            held = _opened(stored) or CuckooFilter.room_for(target)
            for row in changes.to_pylist():
                (held.add if row["new"] else held.remove)(row["key"])
            shard = (changes if changes.num_rows else stored)["shard"][0].as_py()
            return _stored(shard, held)

        changes = new.select("key", F.lit(True).alias("new"))
        if gone is not None:
            changes = changes.unionByName(gone.select("key", F.lit(False).alias("new")))
        changes = changes.withColumn("shard", self._shard())
        return changes.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(change, self.filters.schema)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of `docs` (doc_id, text); references that it has already are not counted again."""
        batch = written(keys_of(docs, self.min_chars), "line-batch")
        if not self.shards:
            refs = batch
            fresh = counts = written(_counted(refs), "line-counts")
        else:
            seen = written(self._seen(batch.select("key").distinct()), "line-seen")
            known = seen.where("seen").select("key")
            # keys the filters don't know are new; of the others the exact tables decide
            held = self.refs.join(known, "key", "left_semi")
            again = batch.join(known, "key", "left_semi")
            missing = again.alias("b").join(
                held.alias("h"), (F.col("b.key") == F.col("h.key")) & F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")), "left_anti"
            )
            new = written(batch.join(known, "key", "left_anti").unionByName(missing), "line-refs")
            refs = self.refs.unionByName(new)
            changed = self.counts.join(known, "key", "left_semi").unionByName(_counted(new))
            merged = changed.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            counts = written(self.counts.join(known, "key", "left_anti").unionByName(merged), "line-counts")
            fresh = _counted(new).join(self.counts, "key", "left_anti")
        keys = counts.count()
        shards = self.shards
        if keys > 2 * SHARD_KEYS * shards:
            shards = max(1, -(-keys // SHARD_KEYS))
        filters = written(self._filters(counts, shards, None, fresh), "line-filters") if shards else self.filters
        return replace(self, refs=refs, counts=counts, filters=filters, shards=shards)

    @classmethod
    def built(cls, docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> LineIndex:
        """An index of `docs`, inserted in batches by a hash of the id; each asks the filters of those before."""
        index = cls.empty(docs.sparkSession, min_chars)
        for number in range(batches):
            index = index.insert(docs.where(_batch(batches) == number))
        return index

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the references of the documents in `ids` (doc_id)."""
        out = ids.select("doc_id").distinct()
        same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id"))
        leaving = self.refs.alias("r").join(out.alias("o"), same, "left_semi").select("key").distinct()
        refs = written(self.refs.alias("r").join(out.alias("o"), same, "left_anti"), "line-refs")
        touched = written(leaving, "line-touched")
        counted = _counted(refs.join(touched, "key", "left_semi"))
        counts = written(self.counts.join(touched, "key", "left_anti").unionByName(counted), "line-counts")
        gone = touched.join(counts, "key", "left_anti")
        filters = self.filters
        if self.shards:
            filters = written(self._filters(counts, self.shards, gone, gone.limit(0)), "line-filters")
        return replace(self, refs=refs, counts=counts, filters=filters)

    def clean(self, docs: DataFrame, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, the columns `keep`, the text left, n_lines and n_dropped of every row of `docs`.

        A key that at least `min_docs` documents hold loses its lines everywhere but in the largest of them.
        """
        often = self.counts.where(F.col("n_docs") >= min_docs).select("key", "last_doc")
        drops = (
            self.refs.join(often, "key")
            .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
            .groupBy(F.col("doc_id").alias("of"))
            .agg(F.collect_list("key").alias("drops"))
        )
        min_chars = self.min_chars
        rows = docs.select("doc_id", "text", *keep)
        names = [*rows.columns, "n_lines", "n_dropped"]
        both = rows.alias("d").join(drops.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.of")), "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    total, dropped, texts = [], [], []
                    for text, drops in zip(part.column(1).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                        lines = (text or "").split("\n")
                        out = set(drops or ())
                        kept = [line for line in lines if line_key(line, min_chars) not in out] if out else lines
                        total.append(len(lines))
                        dropped.append(len(lines) - len(kept))
                        texts.append("\n".join(kept))
                    columns = [part.column(0), pa.array(texts, pa.string()), *part.columns[2:-1], pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                    yield pa.record_batch(columns, names=names)

        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, n_lines long, n_dropped long"
        return both.select("d.*", "x.drops").mapInArrow(run, schema)


def _batch(batches: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(batches))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after the lines that five or more share are dropped.

    The documents are inserted in batches; then one batch is withdrawn and inserted again, as a source that is delivered anew.
    """
    docs = table(spark, sf_dir, "documents")
    index, again = LineIndex.built(docs), docs.where(_batch(DELIVERIES) == 0)
    cleaned = index.delete(again.select("doc_id")).insert(again).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM l),
k AS (
  SELECT r, doc_id, no, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e),
n AS (
  SELECT key, max(doc_id) AS last_doc FROM k
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT r, k.doc_id, no, line, (n.key IS NOT NULL AND k.doc_id <> last_doc) AS out FROM k LEFT JOIN n ON k.key = n.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE out) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT out), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
