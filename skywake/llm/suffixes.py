"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

Windows (strings of ``length`` bytes) are compared within the group of their minimizer, the rarest-looking of their grams by a hash of
the gram alone, so equal windows are always in one group. Neighbouring windows of one minimizer are one segment.

1. Segments of a minimizer that occurs once have no equal. Of the others, equal segments are counted as one, in the map tasks already:
   all but the earliest are removed whole.
2. What is left, different segments of one minimizer, is dealt to shards of about ``SHARD`` bytes. Segments that agree with no other
   of their minimizer on both sides of it, as far as windows would, go, see ``likely``. The others of a shard are a collection of
   short documents, and its Burrows-Wheeler transform is built column by column: each round inserts one more symbol of every
   segment, from the right. The transform and the common prefixes of neighbours lie in files that a round reads and writes
   in sequence, a column at a time. In the end, windows with a common prefix of ``length`` are neighbours, and all but the earliest are removed.
3. A minimizer whose different segments exceed ``SPLIT`` bytes is first dealt anew, by minimizers of its segments that are taken among
   longer grams, the rarest first: how often grams occur in all crowded segments is counted in a table of fixed size. A passage shorter
   than a window that many texts share is passed over that way, for what stands beside it. Grams grow up to a whole window,
   whose group has one segment, so no group above ``SPLIT`` is left, and a shard fits a task's memory: it has whole groups.

Null texts are empty; texts shorter than ``length`` keep all. Rows that share id and text are one document and give the same
result; rows that share the id alone are documents in the order of a hash of their text. A null id comes first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import forget, slices, table, written

LENGTH, GRAM = 100, 40
SHARD, SPLIT = 1 << 19, 1 << 22
#: By how much grams grow from one level to the next, and the size of the table that counts them.
LONGER, COUNTERS = 20, 1 << 18
#: Bytes of a text that are looked at together; positions within fit 20 bits. Short texts are, up to what a processor's cache holds.
PART, TOGETHER = 1 << 19, 1 << 16
END = 0xFF  # no byte of UTF-8
#: Ranges of where in a window its gram stands, by which segments are told apart that share none.
SIDES = 3

COUNTS = pa.schema([("mini", pa.int64()), ("n", pa.int64())])
OCCURRENCES = pa.schema([("mini", pa.int64()), ("digest", pa.int64()), ("did", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
SEGMENTS = pa.schema([("mini", pa.int64()), ("digest", pa.int64()), ("did", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
SPANS = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
KEPT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("text", pa.string())])

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * _A) ^ (left >> np.uint64(29))) + right * _C


def grams(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` bytes, from hashes of its first and last bytes, which overlap unless `size` is a power of two."""
    wide = 8 if size >= 8 else 1
    if len(data) < size:
        return np.zeros(0, np.uint64)
    done = np.lib.stride_tricks.as_strided(data, (len(data) - wide + 1, wide), (1, 1), writeable=False)
    done = np.ascontiguousarray(done).view("<u8").ravel() if wide == 8 else data.astype(np.uint64)
    done = done + np.uint64(1 + 1000 * seed)
    while wide < size:
        apart = min(wide, size - wide)
        done = _joined(done[:-apart], done[apart:])
        wide += apart
    done = (done ^ (done >> np.uint64(30))) * _B
    done = (done ^ (done >> np.uint64(27))) * _C
    return done ^ (done >> np.uint64(31))


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Number, place and bytes of the parts of `texts` that have windows, several short ones at a time."""
    held, total = [], 0
    for number, data in enumerate(texts):
        for begin in range(0, len(data) - length + 1, PART):
            part = data[begin : begin + PART + length - 1]
            if held and total + len(part) > TOGETHER:
                yield held
                held, total = [], 0
            held.append((number, begin, part))
            total += len(part)
    if held:
        yield held


def minimizer_runs(
    texts: list[bytes], length: int = LENGTH, gram: int = GRAM, seed: int = 0, ranks: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, minimizers, starts and numbers of windows of the segments of `texts`, in order, part by part.

    Two equal windows never share a segment: a segment's windows see one gram at different places. With `ranks` (0 to 63, by the
    lowest bits of a gram's hash) a gram of lower rank comes first.
    """
    gram = min(gram, length)
    low = np.uint64(20)
    for held in _parts(texts, length):
        numbers, begins, parts = zip(*held, strict=True)
        ends = np.cumsum([len(part) for part in parts])
        starts = np.append(0, ends[:-1])
        hashes = grams(np.frombuffer(b"".join(parts), np.uint8), gram, seed)
        # the smallest gram of each window, the leftmost among equals
        order = hashes if ranks is None else (ranks[hashes & np.uint64(len(ranks) - 1)] << np.uint64(58)) | (hashes >> np.uint64(6))
        least = (order >> low << low) | np.arange(len(hashes), dtype=np.uint64)
        seen, wide = 1, length - gram + 1
        while seen < wide:
            apart = min(seen, wide - seen)
            least = np.minimum(least[:-apart], least[apart:])
            seen += apart
        where = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        begin = np.append(True, where[1:] != where[:-1])
        begin[starts] = True
        for end in ends[:-1].tolist():  # what runs into the next text is no window
            begin[end - length + 1 : end] = False
        first = np.flatnonzero(begin)
        text = np.searchsorted(starts, first, side="right") - 1
        stops = np.minimum(np.append(first[1:], len(where)), ends[text] - length + 1)
        yield np.array(numbers)[text], hashes[where[first]], first - starts[text] + np.array(begins)[text], stops - first


class Files:
    """The state of a collection between rounds, read and written from beginning to end.

    For each suffix in order: the symbol before it (the transform), the prefix it shares with the one before it, and for suffixes
    that aren't empty the place of what follows their first symbol.
    """

    KINDS = {"symbols": np.uint8, "prefixes": np.uint8, "rests": np.int32}

    def __init__(self, folder: str):
        self.held = {name: open(f"{folder}/{name}", "w+b", buffering=0) for name in self.KINDS}

    def write(self, *columns: np.ndarray) -> None:
        """The next state over the last one, which is never longer."""
        for file, column in zip(self.held.values(), columns, strict=True):
            file.seek(0)
            rest = memoryview(np.ascontiguousarray(column)).cast("B")
            while rest:
                rest = rest[file.write(rest) :]

    def read(self) -> tuple[np.ndarray, ...]:
        for file in self.held.values():
            file.seek(0)
        return tuple(np.frombuffer(file.read(), kind) for file, kind in zip(self.held.values(), self.KINDS.values(), strict=True))

    def close(self) -> None:
        for file in self.held.values():
            file.close()


def transform(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform, the common prefixes and the rests of all suffixes of `documents` (at most 250 bytes, UTF-8).

    Round j inserts the suffixes of length j. Suffixes that begin with one symbol stand in the order of their rests, so the place
    of a new one follows by search from the place of its rest, inserted in the round before.
    """
    count, longest = len(documents), max(map(len, documents))
    column = np.full((longest + 1, count), END, np.uint8)  # symbols from the right
    for number, document in enumerate(documents):
        column[: len(document), number] = np.frombuffer(document, np.uint8)[::-1]
    with tempfile.TemporaryDirectory(prefix="collection-") as folder:
        files = Files(folder)
        files.write(column[0], np.zeros(count, np.uint8), np.zeros(0, np.int32))  # the empty suffixes
        places, numbers = np.arange(count, dtype=np.int32), np.arange(count)  # of the suffixes inserted last
        sizes = np.zeros(257, np.int64)  # of the suffixes by first symbol, moved by one
        for j in range(1, longest + 1):
            symbols, prefixes, rests = files.read()
            first = symbols[places]
            by = np.argsort(first, kind="stable")[: len(first) - np.count_nonzero(first == END)]
            first, places, numbers = first[by], places[by], numbers[by]
            begins = sizes.cumsum()
            kinds, cuts = np.unique(first, return_index=True)
            spots = [
                begins[kind] + np.searchsorted(rests[begins[kind] : begins[kind + 1]], found)
                for kind, found in zip(kinds.tolist(), np.split(places, cuts[1:]), strict=True)
            ]
            spot = np.concatenate(spots)  # of the new among the old suffixes that aren't empty
            sizes[1:] += np.bincount(first, minlength=256)
            at = spot + np.arange(len(spot))
            old = np.ones(len(rests) + len(spot), bool)
            old[at] = False
            joined = np.empty(len(old), np.int32)
            joined[old], joined[at] = rests, places
            # prefixes change at a new suffix and behind it: one symbol and what the rests share
            behind = at[(np.append(at[1:], -1) != at + 1) & (at + 1 < len(joined))] + 1
            changed = np.concatenate([at, behind])
            heads = np.zeros(len(old) + 1, bool)  # the first suffix with a symbol shares nothing
            heads[sizes.cumsum()] = True
            touched = changed[~heads[changed]]
            low, high = joined[touched - 1] + 1, joined[touched] + 1
            least = prefixes[low]
            wide = np.flatnonzero(high - low > 1)
            if len(wide):
                wide = wide[np.argsort(-low[wide])]  # from the right, so that no range between two is read
                ends = np.column_stack([low[wide], high[wide]]).ravel()
                least[wide] = np.minimum.reduceat(np.append(prefixes, np.uint8(0)), ends)[::2]
            common, before = np.empty(count + len(old), np.uint8), np.empty(count + len(old), np.uint8)
            common[:count], before[:count] = prefixes[:count], symbols[:count]
            common[count:][old], before[count:][old] = prefixes[count:], symbols[count:]
            common[count + changed], before[count + at] = 0, column[j, numbers]
            common[count + touched] = least + 1
            moved = np.arange(len(symbols), dtype=np.int32)  # where the old ones go
            moved += np.repeat(np.arange(len(spot) + 1, dtype=np.int32), np.diff(np.concatenate([[0], count + spot, [len(symbols)]])))
            files.write(before, common, moved.take(joined, mode="clip"))
            places = (count + at).astype(np.int32)
        state = files.read()
        files.close()
        return state


def window_classes(documents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, offset and class of the windows of `documents` that have an equal."""
    symbols, prefixes, rests = transform(documents)
    count = len(documents)
    group = np.cumsum(prefixes < length)
    longer = np.empty(len(symbols), np.int64)  # the place of a suffix with the symbol before it
    longer[rests] = count + np.arange(len(rests))
    many = np.bincount(group) > 1
    sizes = np.array([len(d) for d in documents])
    numbers, place, found = np.arange(count), np.arange(count), []
    for j in range(1, int(sizes.max()) + 1):
        on = sizes[numbers] >= j
        numbers, place = numbers[on], longer[place[on]]
        if j >= length:
            hit = many[group[place]]
            found.append((numbers[hit], sizes[numbers[hit]] - j, group[place[hit]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def repeated(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """did, tag, start and stop of the bytes of `rows` (did, tag, start, body) in windows that start earlier elsewhere in them."""
    rows = sorted(rows, key=lambda r: r[:3])
    number, offset, group = window_classes([r[3] for r in rows], length)
    if not len(number):
        return []
    keys = [r[:2] for r in rows]
    rank = np.cumsum([False] + [a != b for a, b in zip(keys, keys[1:])])
    start = np.array([r[2] for r in rows], np.int64)[number] + offset
    by = np.lexsort((start, rank[number], group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    out = by[later]
    by = np.lexsort((offset[out], number[out]))
    number, start = number[out][by], start[out][by]
    if not len(number):
        return []
    cut = np.flatnonzero((number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(number)]]) - 1
    return [(*keys[number[i]], int(start[i]), int(start[k]) + length) for i, k in zip(first, last, strict=True)]


def likely(minis: list[int], rows: list[tuple[int, int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, bytes]]:
    """Those of `rows`, different segments with their minimizers `minis`, that may share a window with another.

    Equal windows have their gram at the same place. By how much of a window lies before it, in `SIDES` ranges, they agree in the gram
    and the least that lies before and behind it. A segment that agrees with no other in any of these has no equal window.
    """
    gram = min(gram, length)
    cuts = [side * (length - gram + 1) // SIDES for side in range(SIDES + 1)]
    hashes = grams(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), gram).view(np.int64)
    ends = np.cumsum([len(r[3]) for r in rows])
    starts = np.append(0, ends[:-1])
    spots = np.flatnonzero(hashes == np.repeat(np.array(minis, np.int64), ends - starts)[: len(hashes)])
    places = spots[np.searchsorted(spots, starts)] - starts  # the first gram is the minimizer
    agree: dict[tuple, list[int]] = {}
    for number, (place, (*_, body)) in enumerate(zip(places.tolist(), rows, strict=True)):
        for side, (least, beyond) in enumerate(zip(cuts, cuts[1:])):
            stop = place + length - beyond + 1
            if least < beyond and place >= least and stop <= len(body):
                agree.setdefault((minis[number], side, body[place - least : stop]), []).append(number)
    shared = {number for held in agree.values() if len(held) > 1 for number in held}
    return [row for number, row in enumerate(rows) if number in shared]


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = [text.encode() for text in part["text"]]
            did, tag = np.array(part["did"], np.int64), np.array(part["tag"], np.int64)
            for number, mini, start, n in minimizer_runs(texts, length):
                stops = start + n + length - 1
                digests = [xxhash.xxh3_64_intdigest(texts[k][i:j]) for k, i, j in zip(number.tolist(), start.tolist(), stops.tolist(), strict=True)]
                columns = mini.astype(np.int64), np.array(digests, np.uint64).astype(np.int64), did[number], tag[number], start, n.astype(np.int32)
                yield pa.record_batch([pa.array(c) for c in columns], schema=OCCURRENCES)

    return docs.mapInArrow(run, "mini long, digest long, did long, tag long, start long, n int")


def _counted(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            held = [mini for _, mini, _, _ in minimizer_runs([text.encode() for text in part["text"]], length)]
            if held:
                mini, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.record_batch([pa.array(mini.astype(np.int64)), pa.array(n.astype(np.int64))], schema=COUNTS)

    return docs.select("text").mapInArrow(run, "mini long, n long")


def _collapsed(found: DataFrame, length: int, *also: str) -> tuple[DataFrame, DataFrame]:
    """The earliest of each segment of a minimizer, where it has several different ones, and the spans of the others."""
    place = F.struct("did", "tag", "start")
    least = found.groupBy("mini", "digest").agg(F.min(place).alias("first"))
    named = found.join(least, ["mini", "digest"])
    earliest = F.struct("did", "tag", "start") == F.col("first")
    spans = named.where(~earliest).select("did", "tag", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    several = least.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("mini")
    return named.where(earliest).join(several, "mini", "left_semi").select("mini", "digest", "did", "tag", "start", "n", *also), spans


def _ranks(segments: DataFrame, gram: int, seed: int) -> np.ndarray:
    """For each counter the binary magnitude of how many grams of the bodies of `segments` fall on it; `COUNTERS` numbers in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for part in slices(batches):
            for body in part["body"]:
                n += np.bincount((grams(np.frombuffer(body, np.uint8), gram, seed) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["counter", "n"])

    counted = segments.select("body").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(COUNTERS, np.uint64)
    ranks[counted["counter"].to_numpy()] = np.log2(counted["n"].to_numpy() + 1.0).astype(np.uint64)
    return ranks


def _deeper(segments: DataFrame, length: int, level: int) -> DataFrame:
    """The segments of `segments` by further minimizers, each within its group, that occur more than once."""
    gram = min(length, GRAM + LONGER * level)
    shared = segments.sparkSession.sparkContext.broadcast(_ranks(segments, gram, level))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for number, minis, starts, sizes in minimizer_runs(part["body"], length, gram, level, shared.value):
                for k, m, i, n in zip(number.tolist(), minis.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                    piece = part["body"][k][i : i + n + length - 1]
                    group = xxhash.xxh3_64_intdigest(m.to_bytes(8, "little"), part["mini"][k] & (1 << 64) - 1)
                    out.append((group, xxhash.xxh3_64_intdigest(piece), part["did"][k], part["tag"][k], part["start"][k] + i, n, piece))
            if out:
                columns = list(zip(*out, strict=True))
                columns[:2] = [np.array(c, np.uint64).astype(np.int64) for c in columns[:2]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SEGMENTS, strict=True)], schema=SEGMENTS)

    found = written(segments.mapInArrow(run, "mini long, digest long, did long, tag long, start long, n int, body binary"), "pieces")
    twice = found.groupBy("mini").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mini")
    return found.join(twice, "mini", "left_semi")


def _levels(segments: DataFrame, length: int, split: int) -> Iterator[tuple[DataFrame, int, list[DataFrame]]]:
    """`segments` in groups of at most `split` bytes, level by level: the groups that are small enough, their bytes, and spans found on the way.

    Tables that no level needs any more are deleted when the next one is asked for.
    """
    level, spans = 0, []
    while True:
        sizes = segments.groupBy("mini").agg(F.sum(F.octet_length("body")).alias("size"))
        total, crowded = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > split, F.col("size")))).first()
        large = sizes.where(F.col("size") > split).select("mini")
        # a group by grams as long as a window has one segment; two are there only if hashes agree
        last = not crowded or GRAM + LONGER * level >= length
        yield segments if last else segments.join(large, "mini", "left_anti"), (total or 0) - (0 if last else crowded), spans
        if last:
            forget(segments)
            return
        level += 1
        pieces = written(_deeper(segments.join(large, "mini", "left_semi"), length, level), "pieces")
        different, more = _collapsed(pieces, length, "body")
        spans, before = [written(more, "spans")], segments
        segments = written(different, "segments")
        forget(before, pieces)


def _bodies(docs: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """`segments` with their bytes, cut from `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out = []
            for did, tag, text, held in zip(part["did"], part["tag"], part["text"], part["held"], strict=True):
                data = text.encode()
                out += [(h["mini"], h["digest"], did, tag, h["start"], h["n"], data[h["start"] : h["start"] + h["n"] + length - 1]) for h in held]
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(SEGMENTS)], schema=SEGMENTS)

    by_document = segments.groupBy("did", "tag").agg(F.collect_list(F.struct("mini", "digest", "start", "n")).alias("held"))
    both = docs.select("did", "tag", "text").join(by_document, ["did", "tag"])
    return both.mapInArrow(run, "mini long, digest long, did long, tag long, start long, n int, body binary")


def repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """did, tag, start and stop of the bytes to remove (spans may overlap) of `docs` (did, tag, text), as a table."""
    if not 1 <= length <= 125:
        raise ValueError("segments of up to twice the length have to fit 250 bytes")
    twice = _counted(docs, length).groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1").select("mini")
    found = written(_occurrences(docs, length).join(twice, "mini", "left_semi"), "occurrences")
    different, spans = _collapsed(found, length)
    segments = written(_bodies(docs, different, length), "segments")
    spans = [written(spans, "spans")]
    forget(found)

    def found_in(group: pa.Table, first: bool) -> pa.Table:
        columns = [group[c].to_pylist() for c in ("mini", "did", "tag", "start", "body")]
        held = sorted(set(zip(*columns, strict=True)))  # documents that repeat bring a segment again
        minis, rows = [h[0] for h in held], [h[1:] for h in held]
        rows = likely(minis, rows, length) if first else rows  # at other levels the minimizer doesn't tell the gram
        out = repeated(rows, length) if rows else []
        return pa.table([pa.array([o[i] for o in out], f.type) for i, f in enumerate(SPANS)], schema=SPANS)

    for level, (here, size, more) in enumerate(_levels(segments, length, split)):
        run = (lambda group: found_in(group, False)) if level else (lambda group: found_in(group, True))
        dealt = here.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(max(1, -(-size // shard)))))
        spans += [*more, written(dealt.groupBy("shard").applyInArrow(run, "did long, tag long, start long, stop long"), "spans")]
    return reduce(DataFrame.unionByName, spans)


def without_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, split: int = SPLIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, n_bytes, n_removed, n_spans (maximal runs removed), kept and text of every row of `docs` (doc_id, text).

    `kept` are the bytes that stay; `text` is what they spell, without characters of which only some bytes stay.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long")
    spans = repeats(docs.select(key.alias("did"), F.xxhash64(text).alias("tag"), text.alias("text")), length, shard, split)
    by_document = spans.groupBy("did", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select("doc_id", *keep, text.alias("text"))
    same = (F.coalesce("d.doc_id", F.lit(-(1 << 63))) == F.col("s.did")) & (F.xxhash64("d.text") == F.col("s.tag"))
    names = [*rows.columns[:-1], *KEPT.names]
    both = rows.alias("d").join(by_document.alias("s"), same, "left").select("d.*", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = []
                for text, spans in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    data, kept, end, runs = text.encode(), [], 0, 0
                    for begin, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                        if begin > end or not runs:
                            kept.append(data[end:begin])
                            runs += 1
                        end = max(end, stop)
                    kept.append(data[end:])
                    left = b"".join(kept)
                    out.append((len(data), len(data) - len(left), runs, left, left.decode(errors="ignore")))
                columns = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(KEPT)]
                yield pa.record_batch([*part.columns[:-2], *columns], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return both.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that start earlier already."""
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
