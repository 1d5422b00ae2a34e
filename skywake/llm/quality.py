"""Quality classifier by supervised subword embeddings.

A text's features are its words, the character n-grams of each word, the pairs of neighbouring words (a word that follows
itself is one pair of its own, whatever the word) and all are hashed to buckets. Each bucket has a learned vector; a text is
the mean of its features' vectors, and a softmax over it gives the classes. Vectors and softmax are trained together by
stochastic gradient descent in numpy.

Training takes a bounded sample: of the distinct labelled rows whose text has at most ``longest`` characters, the ``rows`` with the
smallest hash of their id, as far as their texts have ``characters`` together. One task trains on them; the driver sees their ids and
the model, never a text. Scoring takes whole texts of every length. As the output is linear in the mean, each bucket's
vector is folded to one number per class first, and each word to the sum of its features.

Null and empty texts have no feature: the softmax of the bias alone is their score. Without a label to learn from, every score
is 0.5. Rows that repeat are scored each for itself; labels that are null teach nothing, and a row
or a label that repeats teaches once; an id with several texts or labels teaches each of its pairs.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import crc_mod, fresh, table

BUCKETS, DIMENSIONS = 1 << 18, 8
NGRAMS = (3, 4)
ROWS, LONGEST, CHARACTERS = 2_000, 50_000, 20_000_000
EPOCHS, RATE = 6, 0.5
THRESHOLD = 0.3
#: Words whose feature sums are remembered; the memory is emptied at this size.
WORDS = 300_000

_SCORERS: dict = {}


def word_buckets(word: str, buckets: int, ngrams: tuple[int, int]) -> list[int]:
    """Buckets of a word and of its n-grams, counted in characters between its marked ends."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(ngrams[0], ngrams[1] + 1) for i in range(max(0, len(marked) - n + 1))} | {marked}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in sorted(grams)]


@lru_cache(20_000)
def _word_buckets(word: str, buckets: int, ngrams: tuple[int, int]) -> np.ndarray:
    return np.array(word_buckets(word, buckets, ngrams), np.int32)


def pair_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of neighbouring words from the words' hashes."""
    first, second = hashes[:-1], hashes[1:]
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(first == second, np.uint64(1), (mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) + 2


@dataclass
class Model:
    """`weights` has a row per bucket and a column per class; `bias` has the classes' offsets."""

    weights: np.ndarray
    bias: np.ndarray
    ngrams: tuple[int, int]

    def scorer(self):
        """The chance of class 1 of a text."""
        # of two classes only the difference counts; a list gives single numbers faster than an array
        lean, buckets = self.weights[:, 1] - self.weights[:, 0], len(self.weights)
        single, offset = lean.tolist(), float(self.bias[1] - self.bias[0])
        known: dict[str, int] = {}
        block = WORDS // 2
        sums, counts, hashes = np.zeros(WORDS + block + 1), np.zeros(WORDS + block + 1, np.int64), np.zeros(WORDS + block + 1, np.uint64)

        def score(text: str | None) -> float:
            words = (text or "").split()
            total, features = 0.0, 0
            for at in range(0, len(words), block):
                part = words[at : at + block + 1]  # one word more than the block, for the pair across its end
                if len(known) > WORDS:
                    known.clear()
                for word in part:
                    if word not in known:
                        place = known[word] = len(known)
                        found = word_buckets(word, buckets, self.ngrams)
                        sums[place], counts[place], hashes[place] = sum([single[f] for f in found]), len(found), word_hash(word)
                places = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                total += sums[places[:block]].sum()
                features += int(counts[places[:block]].sum())
                if len(part) > 1:
                    pairs = pair_buckets(hashes[places], buckets)
                    total += lean[pairs].sum()
                    features += len(pairs)
            return 1 / (1 + math.exp(min(700.0, -(offset + total / max(1, features)))))

        return score


def features(text: str, buckets: int, ngrams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split()
    found = [_word_buckets(w, buckets, ngrams) for w in words]
    if len(words) > 1:
        found.append(pair_buckets(np.array([word_hash(w) for w in words], np.uint64), buckets).astype(np.int32))
    held, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
    return held, (counts / max(1, counts.sum())).astype(np.float32)


def train(
    examples: list[tuple[str, int]],
    classes: int = 2,
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    ngrams: tuple[int, int] = NGRAMS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 7,
) -> Model:
    """Embeddings and softmax fitted to (text, class) examples."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    top, bias = np.zeros((dimensions, classes), np.float32), np.zeros(classes, np.float32)
    # all features one behind the other, in memory that the task gives back as a whole
    all_found, all_shares, bounds = array("i"), array("f"), [0]
    for text, _ in examples:
        found, shares = features(text, buckets, ngrams)
        all_found.frombytes(found.tobytes())
        all_shares.frombytes(shares.tobytes())
        bounds.append(len(all_found))
    _word_buckets.cache_clear()
    steps = 0
    for _ in range(epochs):
        for place in rng.permutation(len(examples)):
            within, label = slice(bounds[place], bounds[place + 1]), examples[place][1]
            found, shares = np.asarray(all_found)[within], np.asarray(all_shares)[within]
            pace = rate * (1 - steps / (epochs * len(examples)))
            steps += 1
            mean = shares @ vectors[found]
            logits = mean @ top + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = top @ error
            top -= pace * np.outer(mean, error)
            bias -= pace * 0.1 * error
            # a bucket's step is its share of the text, scaled so that a text moves its mean by about one step
            vectors[found] -= np.outer(pace * shares / max(1e-6, float(shares @ shares)) * 0.5, back)
    return Model((vectors.astype(np.float64) @ top.astype(np.float64)), bias.astype(np.float64), ngrams)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, longest: int = LONGEST, characters: int = CHARACTERS) -> DataFrame:
    """doc_id, text, quality: the bounded sample of the labelled, `usable` rows of `docs` that a model is trained on."""
    marks = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    known = docs.where(usable & F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    # rows are joined and ranked without their texts, by id and hash of the text, then the few chosen ones fetch theirs once
    keys = known.select("doc_id", "tag", F.length("text").alias("size")).distinct()
    ranked = marks.join(keys, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "tag").limit(rows).collect()
    upto = accumulate(row["size"] for row in ranked)
    held = [(row["doc_id"], row["tag"], row["quality"]) for row, total in zip(ranked, upto, strict=True) if total <= characters]
    kinds = known.schema
    chosen = F.broadcast(docs.sparkSession.createDataFrame(held, f"doc_id {kinds['doc_id'].dataType.simpleString()}, tag long, quality int"))
    texts = known.join(F.broadcast(chosen.select("doc_id", "tag").distinct()), ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.min("text").alias("text"))
    return texts.join(chosen, ["doc_id", "tag"]).select("doc_id", "text", "quality")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, longest: int = LONGEST, characters: int = CHARACTERS) -> Model | None:
    """A model of `labels.quality`, trained on the sample in one task; None without labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row["doc_id"], row["text"], row["quality"]) for batch in batches for row in batch.to_pylist())
        if found:
            model = train([(text, int(quality == 1)) for _, text, quality in found])
            yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary())], names=["weights", "bias"])

    held = sample(docs, labels, usable, rows, longest, characters).repartition(1).mapInArrow(run, "weights binary, bias binary").first()
    if held is None:
        return None
    bias = np.frombuffer(held["bias"])
    return Model(np.frombuffer(held["weights"]).reshape(-1, len(bias)), bias, NGRAMS)


def kept_scorer(name: str, model: Model):
    """The model's scorer, which a worker's later tasks find with the words of the earlier ones."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = model.scorer()
    return _SCORERS[name]


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score, the chance of class 1, and predicted, 1 from `threshold` on; columns of `docs` by these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of buckets
    name = fresh("model")
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = kept_scorer(name, shared.value) if shared.value else lambda text: 0.5
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores = [rate(text) for text in part.column("text").to_pylist()]
                more = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                yield pa.record_batch([*part.columns, *more], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
