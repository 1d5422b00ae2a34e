"""Toxicity by a classifier that is trained on counterfactuals as well.

A text's features are its words (letters, digits and _, in lower case) and the character n-grams of each word between its marked ends, all
hashed to buckets. The log-odds of a text are an offset and the mean, over its words, of the sum of their features' weights.

Weights are fitted by stochastic gradient descent (steps scaled by each weight's own history, and smaller towards the end) to the
logistic loss of labelled texts. A feature counts by the cube of its log-ratio, how much more of it one class has than the other, and
one in fewer than `seen` texts not at all, so that what is common to both classes, or met by chance, learns little. In addition,
sentences of these texts that name a group of people (`terms`: lists of words that can stand for each other) are paired with the same
sentence about another group of the list, and the square of the difference of their log-odds is a penalty, `fairness` times as
important as the loss. So what a group is called comes to matter little, and a neutral sentence isn't toxic for the groups
that toxic ones name. The list is a parameter; texts that name none of them teach without pairs.

Training takes a bounded sample in one task: of the distinct labelled rows whose text has at most ``longest`` characters, the ``rows`` with the
smallest hash of their id, as far as their texts have ``characters`` together. Scoring takes whole texts of every length; every distinct
word of neighbouring texts is looked up once.

Null and empty texts, and those without a word, have the offset's score. Without a label to learn from, every score is 0.5. Rows that
repeat are scored each for itself; a null label teaches nothing, a row or label that repeats teaches once, and an id with
several texts or labels teaches each of its pairs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import crc_mod, table

BUCKETS = 1 << 20
NGRAMS = (4, 5, 6)
#: Characters of marked words that are looked at together. Longer words are looked at in pieces that overlap by one less than the longest n-gram.
WIDTHS = (12, 40)
ROWS, LONGEST, CHARACTERS = 6_000, 50_000, 30_000_000
EPOCHS, RATE, FAIRNESS = 8, 1.0, 1.0
#: Texts that a feature must be in, and words of it that each class is taken to have besides, for its log-ratio.
SEEN, SMOOTH = 5, 0.05
THRESHOLD = 0.3
#: Characters of the texts that are scored together.
PORTION = 1 << 20

# fixed values: words for groups of people that can stand for each other, by kind and language
TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("american", "african", "asian", "european", "arab", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
    ("black", "white", "latino", "hispanic"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("blind", "deaf", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "katholiken", "protestanten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques", "protestants", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos", "protestantes", "ateos"),
)

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(part: list[str], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of texts of at most `width` characters (a row each), and which there are."""
    marked = np.array(part, f"U{width}")
    codes = marked.view(np.uint32).reshape(len(part), width).astype(np.uint64)
    sizes = np.char.str_len(marked)
    found, there = [], []
    for n in NGRAMS:
        places = width - n + 1
        held = np.full((len(part), places), n, np.uint64)
        for i in range(n):
            held = held * _A + codes[:, i : i + places] + _C
        found.append(mix(held) % np.uint64(buckets))
        there.append(np.arange(places) + n <= sizes[:, None])
    return np.hstack(found).astype(np.int32), np.hstack(there)


def word_features(distinct: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in `distinct`, buckets of the word or of its n-grams (a row a place, which can come again) and which of them there are."""
    import pandas as pd  # in the tasks alone, the driver has no use for it

    if not distinct:
        return
    whole = (pd.util.hash_array(np.array(distinct, object), categorize=False) % np.uint64(buckets)).astype(np.int32)
    yield np.arange(len(distinct)), whole[:, None], np.ones((len(distinct), 1), bool)
    pieces: tuple[list, list] = ([], [])  # narrow and wide ones
    for place, word in enumerate(distinct):
        marked = f"<{word}>"
        wide = len(marked) > WIDTHS[0]
        for start in range(0, max(1, len(marked) - max(NGRAMS) + 1), WIDTHS[wide] - max(NGRAMS) + 1):
            pieces[wide].append((place, marked[start : start + WIDTHS[wide]]))
    for width, held in zip(WIDTHS, pieces, strict=True):
        for start in range(0, len(held), 1 << 14):
            places, texts = zip(*held[start : start + (1 << 14)], strict=True)
            yield np.array(places), *_grams(list(texts), width, buckets)


def features(tokens: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's words and how many a word it has of each."""
    counts: dict[str, int] = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    each = np.fromiter(counts.values(), float, len(counts))
    found, shares = [], []
    for places, held, there in word_features(list(counts), buckets):
        found.append(held[there])
        shares.append(np.broadcast_to(each[places, None], there.shape)[there])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    distinct, back = np.unique(np.concatenate(found), return_inverse=True)
    return distinct, (np.bincount(back, np.concatenate(shares)) / len(tokens)).astype(np.float32)


def counterfactuals(text: str, terms: tuple = TERMS) -> Iterator[tuple[list[str], list[str]]]:
    """The words of each sentence that names a group, and those of the same sentence about the next group of the list."""
    others = {term: group[(place + 1) % len(group)] for group in reversed(terms) for place, term in enumerate(group)}
    for sentence in SENTENCE.split(text):
        tokens = words(sentence)
        if any(t in others for t in tokens):
            yield tokens, [others.get(t, t) for t in tokens]


@dataclass
class Model:
    """A weight a bucket, and the offset."""

    weights: np.ndarray
    offset: float

    def log_odds(self, texts: list[list[str]]) -> np.ndarray:
        """Of texts given as words."""
        import pandas as pd  # in the tasks alone, the driver has no use for it

        sizes = np.array([len(t) for t in texts], np.int64)
        codes, distinct = pd.factorize(np.array([w for t in texts for w in t], object))
        values = np.zeros(len(distinct))
        for places, found, there in word_features(list(distinct), len(self.weights)):
            np.add.at(values, places, np.where(there, self.weights[found], 0).sum(axis=1))
        totals = np.bincount(np.repeat(np.arange(len(texts)), sizes), values[codes], len(texts))
        return self.offset + totals / np.maximum(1, sizes)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts), -700, 700)))


class Examples:
    """Features and shares of many texts, one behind the other, in memory that the task gives back as a whole."""

    def __init__(self, found: Iterable[tuple[np.ndarray, np.ndarray]]):
        held, shares, self.bounds = array("i"), array("f"), [0]
        for buckets, amounts in found:
            held.frombytes(buckets.tobytes())
            shares.frombytes(amounts.astype(np.float32).tobytes())
            self.bounds.append(len(held))
        self.found, self.shares = np.asarray(held), np.asarray(shares)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        within = slice(self.bounds[place], self.bounds[place + 1])
        return self.found[within], self.shares[within]

    def scales(self, labels: np.ndarray, buckets: int, seen: int, smooth: float) -> np.ndarray:
        """How much each bucket counts."""
        classes = np.repeat(labels, np.diff(self.bounds))
        ratio = np.zeros(buckets)
        for label, sign in ((1, 1), (0, -1)):
            amount = np.bincount(self.found[classes == label], self.shares[classes == label], buckets)
            ratio += sign * np.log((amount + smooth) / max(1, (labels == label).sum()))
        return np.where(np.bincount(self.found, minlength=buckets) >= seen, np.abs(ratio) ** 3, 0)


def _apart(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text less those of the other, where they differ."""
    found, back = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    amounts = np.bincount(back, np.concatenate([left[1], -right[1]]), len(found))
    return found[amounts != 0], amounts[amounts != 0]


def train(
    examples: list[tuple[str, int]],
    terms: tuple = TERMS,
    fairness: float = FAIRNESS,
    buckets: int = BUCKETS,
    seen: int = SEEN,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 7,
) -> Model:
    """Weights fitted to (text, 0 or 1) examples and to the counterfactuals of their sentences."""
    rng = np.random.default_rng(seed)
    labels = np.array([label for _, label in examples])
    held = Examples(features(words(text), buckets) for text, _ in examples)
    pairs = Examples(_apart(features(a, buckets), features(b, buckets)) for text, _ in examples for a, b in counterfactuals(text, terms))
    scales = held.scales(labels, buckets, seen, SMOOTH)
    weights, past = np.zeros(buckets), np.full(buckets, 1e-6)
    likely = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    offset, before = float(np.log(likely / (1 - likely))), 1.0
    steps = epochs * (len(held) + len(pairs))
    for number, place in enumerate(np.concatenate([rng.permutation(len(held) + len(pairs)) for _ in range(epochs)]).tolist()):
        pace = rate * (1 - number / steps)
        found, amounts = held[place] if place < len(held) else pairs[place - len(held)]
        amounts = amounts * scales[found]
        odds = float(amounts @ weights[found])
        if place < len(held):
            error = 1 / (1 + np.exp(-np.clip(offset + odds, -30, 30))) - labels[place]
            before += error**2
            offset -= 0.1 * pace * error / np.sqrt(before)
        else:
            error = 2 * fairness * odds
        past[found] += (error * amounts) ** 2
        weights[found] -= pace * error * amounts / np.sqrt(past[found])
    return Model(weights * scales, offset)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, longest: int = LONGEST, characters: int = CHARACTERS) -> DataFrame:
    """doc_id, text, toxic: the bounded sample of the labelled, `usable` rows of `docs` that a model is trained on."""
    marks = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    known = docs.where(usable & F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    # rows are joined and ranked without their texts, by id and hash of the text, then the few chosen ones fetch theirs once
    keys = known.select("doc_id", "tag", F.length("text").alias("size")).distinct()
    ranked = marks.join(keys, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "tag").limit(rows).collect()
    upto = accumulate(row["size"] for row in ranked)
    held = [(row["doc_id"], row["tag"], row["toxic"]) for row, total in zip(ranked, upto, strict=True) if total <= characters]
    kind = known.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(held, f"doc_id {kind}, tag long, toxic int"))
    texts = known.join(F.broadcast(chosen.select("doc_id", "tag").distinct()), ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.min("text").alias("text"))
    return texts.join(chosen, ["doc_id", "tag"]).select("doc_id", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, terms: tuple = TERMS, fairness: float = FAIRNESS, **bounds: int) -> Model | None:
    """A model of `labels.toxic`, trained on the sample in one task; None without labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row["doc_id"], row["text"], row["toxic"]) for batch in batches for row in batch.to_pylist())
        if found:
            model = train([(text, int(toxic == 1)) for _, text, toxic in found], terms, fairness)
            places = np.flatnonzero(model.weights)
            columns = [places.astype("<i4").tobytes(), model.weights[places].tobytes(), model.offset]
            yield pa.record_batch([pa.array([c]) for c in columns], names=["places", "weights", "shift"])

    held = sample(docs, labels, usable, **bounds).repartition(1).mapInArrow(run, "places binary, weights binary, shift double").first()
    if held is None:
        return None
    weights = np.zeros(BUCKETS)
    weights[np.frombuffer(held["places"], "<i4")] = np.frombuffer(held["weights"])
    return Model(weights, held["shift"])


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """Neighbouring texts of about `PORTION` characters at most together, or a longer one alone."""
    held, size = [], 0
    for place in range(len(texts)):
        text = texts[place].as_py()
        if held and size + len(text or "") > PORTION:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score, the chance of being toxic, and predicted, 1 from `threshold` on; columns of `docs` by these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of buckets
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            done = 0
            for texts in _portions(batch.column("text")):
                scores = model.scores([words(t) for t in texts]) if model else np.full(len(texts), 0.5)
                part = batch.slice(done, len(texts))
                done += len(texts)
                more = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.record_batch([*part.columns, *more], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
