"""Periodic runs of words, found by multi-scale minimizers.

Words are the stretches of a text between ASCII blanks. A run is a stretch of words with smallest period q (words q apart are
identical), at least max(LEAST, TIMES * q) words long, that no neighbouring word extends with that period.

1. Periods up to SHORT are found by direct lag scans: where the words equal those q further, for long enough, is a run.
2. Longer periods are found scale by scale; a scale has those from `low` up to its gram length k. Grams at least a period long occur within a run
   only a multiple of the period apart. The minima, by hash, of all windows of w neighbouring grams repeat a period further on in
   a run, as long as a window and its copy both lie in it, which w = (TIMES - 1) * low - k + 1 ensures. So among a
   scale's minimizers, by hash and place, neighbours that are a period apart seed every run.
3. Seeds are extended word by word on both sides, once for each run. What turns out to have a smaller period is not a run of this one.

Many short texts are looked at together, with a word of its own behind each, which no run can cross. All of a text is looked at; a
text is in one task, in memory that is a multiple of its length. Null and empty texts, and those of blanks alone, have no word and no run.
Rows that repeat are looked at each for itself; ids play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import crc_mod, table

LEAST, TIMES = 24, 3
#: Periods of direct scans.
SHORT = 16
#: Words that are looked at together, unless one text has more.
WORDS = 1 << 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mix(first * _A + mix(second + _C))


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """`low`, gram length and window of the scales for periods from SHORT + 1 to `longest`."""
    low = SHORT + 1
    while low <= longest:
        k = max(low, (low - 1) * 3 // 2)
        yield low, k, (TIMES - 1) * low - k + 1
        low = k + 1


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """`least` (np.minimum or np.maximum) over each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    return least(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the smallest of some window of that many, ties included."""
    if len(grams) <= window:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = sliding(grams, window, np.minimum)
    # a gram is chosen if the largest minimum of the windows it is in is its own
    pad = np.zeros(window - 1, grams.dtype)
    most = sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    return np.flatnonzero(most == grams)


def _reach(words: np.ndarray, at: int, period: int, end: int) -> int:
    """How many words from `at` on, before `end`, equal the word a period further."""
    found, step = 0, 64
    while at + found + period < end:
        stop = min(at + found + step, end - period)
        differ = words[at + found : stop] != words[at + found + period : stop + period]
        if differ.any():
            return found + int(differ.argmax())
        found, step = stop - at, step * 2
    return found


def _reach_back(words: np.ndarray, at: int, period: int) -> int:
    """How many words before `at` equal the word a period further."""
    found, step = 0, 64
    while found < at:
        size = min(step, at - found)
        left = at - found - size
        differ = words[left : left + size] != words[left + period : left + size + period]
        if differ.any():
            return found + int(differ[::-1].argmax())
        found, step = found + size, step * 2
    return found


def _primitive(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """That no smaller period holds from `start` to `end`; there are two periods at least, so a smaller one would divide this one."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            smaller = period // factor
            if (words[start : end - smaller] == words[start + smaller : end]).all():
                return False
            while left % factor == 0:
                left //= factor
        factor += 1
    return True


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """start, length and period of all runs among `words` (numbers), by start, then period; `longest` bounds the length of a run."""
    n = len(words)
    longest = n if longest is None else longest
    runs = []
    for period in range(1, min(SHORT, longest // TIMES) + 1):
        same = words[:-period] == words[period:]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + period
        fit = ends - starts >= max(LEAST, TIMES * period)
        runs += [(s, e - s, period) for s, e in zip(starts[fit].tolist(), ends[fit].tolist(), strict=True) if _primitive(words, s, e, period)]
    doubled, size = mix(words.astype(np.uint64) + _A), 1  # hashes of the stretches of `size` words
    for low, k, window in scales(longest // TIMES):
        while 2 * size <= k:
            doubled, size = joined(doubled[:-size], doubled[size:]), 2 * size
        grams = joined(doubled[: n - k + 1], doubled[k - size : n - size + 1])
        chosen = minimizers(grams, window)
        chosen = chosen[np.argsort(grams[chosen], kind="stable")]
        apart = np.diff(chosen)
        seeds = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (apart >= low) & (apart <= k))
        periods, places = apart[seeds], chosen[seeds]
        order = np.lexsort((places, periods))
        done = (0, 0)  # period and end of the stretch before
        for period, place in zip(periods[order].tolist(), places[order].tolist(), strict=True):
            if done[0] == period and place < done[1] - period:
                continue
            start = place - _reach_back(words, place, period)
            end = place + _reach(words, place, period, n) + period
            done = period, end
            if end - start >= max(LEAST, TIMES * period) and _primitive(words, start, end, period):
                runs.append((start, end - start, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of `n` words stay: not those of a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return change.cumsum()[:n] == 0


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of the texts as numbers, with one of its own behind each text."""
    import pandas as pd  # in the tasks alone, the driver has no use for it

    flat = np.array([w for text in texts for w in [*text, None]], object)
    codes, _ = pd.factorize(flat)  # None is -1
    ends = np.flatnonzero(codes < 0)
    codes[ends] = -1 - np.arange(len(ends))
    return codes


def _looked_at(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text."""
    words = _numbered(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    held: list[list] = [[] for _ in texts]
    runs = find_runs(words, max(map(len, texts)))
    owners = np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), runs, strict=True):
        held[owner].append((start - int(bounds[owner]), length, period))
    yield from held


def _portions(texts: pa.Array, words: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of neighbouring texts, about `words` together at most, and the place of the first."""
    start, held, size = 0, [], 0
    for place in range(len(texts)):
        found = (texts[place].as_py() or b"").split()  # at ASCII blanks
        if held and size + len(found) > words:
            yield start, held
            start, held, size = place, [], 0
        held.append(found)
        size += len(found) + 1
    if held:
        yield start, held


def periodic_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the words that stay, one space between) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, held in _portions(batch.column("text"), words):
                runs = list(_looked_at(held))
                collapsed = []
                for text, found in zip(held, runs, strict=True):
                    stay = text
                    if found:
                        stay = [w for w, k in zip(text, kept_words(len(text), found).tolist(), strict=True) if k]
                    collapsed.append(b" ".join(stay))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(start, len(held)),
                        pa.array([len(t) for t in held], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], pa.list_(RUN)),
                        pa.array(collapsed, pa.binary()).view(pa.string()),
                    ],
                    schema=FOUND,
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the one with the greatest exponent (exact; ties: first, then shortest period) and digests of `periodic_runs`."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(ahead(b, a), b).otherwise(a))  # runs come by start, then period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def given_text(doc_id: Column, text: Column) -> Column:
    """The text that `op13` looks at: in a tenth of the texts, by a hash of the id, the words from one on repeat with a period."""
    g = F.floor(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        each = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(each, " ")).otherwise(text)

    # the words are a variable of the function, so that a text is split once
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    return F.when(crc_mod(doc_id, 10) == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of which repeat as the query's contract says."""
    docs = table(spark, sf_dir, "documents")
    return digests(periodic_runs(docs.select("doc_id", given_text(F.col("doc_id"), F.col("text")).alias("text"))))
