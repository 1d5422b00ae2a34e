"""The toxicity classifier against a plain sum over its features, and what its counterfactuals are for."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywake.llm import toxicity

INSULTS = ["blorg", "snarfle", "grumpet"]
GROUPS = (("northerners", "southerners", "easterners", "westerners"),)


def _sentence(rng, *more):
    held = [rng.choice("abcdefgh") + rng.choice(["ano", "elo", "iru", "ota"]) for _ in range(rng.randint(6, 12))] + list(more)
    rng.shuffle(held)
    return " ".join(held) + "."


def _examples(rng, count=150):
    """Toxic sentences about two of the groups, others that mostly name none."""
    toxic = [(_sentence(rng, rng.choice(INSULTS), rng.choice(["northerners", "southerners"])), 1) for _ in range(count)]
    clean = [(_sentence(rng, *(["easterners"] if rng.random() < 0.1 else [])), 0) for _ in range(2 * count)]
    return toxic + clean


def test_counterfactuals_keep_neutral_mentions_clean():
    rng = random.Random(2)
    examples = _examples(rng)
    plain = toxicity.train(examples, (), seen=2)
    fair = toxicity.train(examples, GROUPS, 5.0, seen=2)
    neutral = [toxicity.words(_sentence(rng, "northerners")) for _ in range(80)]
    toxic = [toxicity.words(_sentence(rng, rng.choice(INSULTS), group)) for _ in range(20) for group in GROUPS[0]]
    assert (plain.scores(neutral) >= toxicity.THRESHOLD).mean() > 0.5  # named by toxic sentences alone
    assert (fair.scores(neutral) >= toxicity.THRESHOLD).mean() < 0.05
    assert (fair.scores(toxic) >= toxicity.THRESHOLD).mean() > 0.95
    swapped = [[b if w == a else w for w in text] for text in neutral for a, b in [("northerners", "westerners")]]
    assert abs(fair.log_odds(neutral) - fair.log_odds(swapped)).mean() < abs(plain.log_odds(neutral) - plain.log_odds(swapped)).mean() / 3


def test_each_sentence_that_names_a_group_is_swapped():
    held = list(toxicity.counterfactuals("Northerners came! Nobody else.\nThen WESTERNERS, then southerners", GROUPS))
    assert held == [(["northerners", "came"], ["southerners", "came"]), (["then", "westerners", "then", "southerners"], ["then", "northerners", "then", "easterners"])]
    assert not list(toxicity.counterfactuals("", GROUPS)) and all(len(g) == len(set(g)) > 1 for g in toxicity.TERMS)


def _plain(model, text):
    """The log-odds by the definition, n-gram by n-gram."""
    words = toxicity.words(text)
    total = 0.0
    for w in words:
        for _, found, there in toxicity.word_features([w], len(model.weights)):
            total += model.weights[found[there]].sum()
    return model.offset + total / max(1, len(words))


def test_scores_are_the_mean_of_the_words_sums(llm):
    rng = random.Random(5)
    model = toxicity.train(_examples(rng, 30), seen=1, buckets=1 << 14)
    texts = [None, "", " .\n", "one", "a a a", "é ñ 日本", "x" * 5_000, "blorg " * 3_000] + [_sentence(rng, rng.choice(INSULTS)) for _ in range(30)]
    rows = [(k, t, "mine", 5, True) for k, t in enumerate(texts)] + [(3, "one", "mine", 5, False)] * 2 + [(None, "blorg", "mine", 5, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, score string, predicted int, held_out boolean")
    held = toxicity.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in held) == sorted(str(r[0]) for r in rows)
    for r in held:
        assert r.score == pytest.approx(1 / (1 + np.exp(-_plain(model, r.text))), rel=1e-9)
        assert r.predicted == (r.score >= toxicity.THRESHOLD)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.5}


@pytest.mark.parametrize("word", ["a", "abcdef", "abcdefghij", "abcdefghijk", "x" * 38, "0123456789" * 13])
def test_all_of_a_word_counts(word):
    seen = {n: set() for n in toxicity.NGRAMS}
    marked = f"<{word}>"
    asked = {n: {marked[i : i + n] for i in range(len(marked) - n + 1)} for n in seen}
    every = {b for _, found, there in toxicity.word_features([word]) for b in found[there].tolist()}
    for n, grams in asked.items():
        for gram in grams:
            found, there = toxicity._grams([gram], 12, toxicity.BUCKETS)
            column = sum(12 - m + 1 for m in toxicity.NGRAMS if m < n)
            assert there[0, column] and found[0, column] in every
    assert len(every) == 1 + sum(map(len, asked.values()))


def test_toxicity_is_learned_from_labels(llm):
    rng = random.Random(7)
    rows = [(k, " ".join([_sentence(rng) for _ in range(5)] + [_sentence(rng, *(INSULTS if k % 4 == 0 else []))])) for k in range(400)]
    docs = llm.createDataFrame([*rows, (900, None), (901, ""), (None, "x " * 60_000), (902, "blorg " * 30_000)], "doc_id long, text string")
    labels = llm.createDataFrame([(k, 0, int(k % 4 == 0)) for k, _ in rows] + [(5000, 0, 1), (None, 0, 1), (3, 0, None), (900, 0, 1)], "doc_id long, quality int, toxic int")
    held_out = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    model = toxicity.learn(docs, labels, ~held_out)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([found[k].predicted == (k % 4 == 0) for k, _ in rows if k % 3 == 0]) > 0.97
    assert len(found) == 404 and found[900].score == found[901].score and found[902].predicted == 1
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs.repartition(7), labels, ~held_out)).collect()}
    assert again == {k: r.score for k, r in found.items()}
    for nothing in (labels.limit(0), labels.where("doc_id = 5000"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.learn(docs, nothing, ~held_out) is None
    assert toxicity.learn(docs, labels.withColumn("toxic", F.lit(0)), ~held_out).scores([["blorg"]])[0] < toxicity.THRESHOLD


def test_rows_that_repeat_teach_once_and_within_the_bound(llm):
    docs = llm.createDataFrame([(1, "one")] * 30 + [(1, "other"), (2, "two"), (2, "two"), (3, "three")], "doc_id long, text string")
    labels = llm.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, toxic int")

    def learned(**bounds):
        return sorted((r.text, r.toxic) for r in toxicity.sample(docs, labels, F.lit(True), **bounds).collect())

    pairs = [("one", 1), ("other", 1), ("three", 0), ("two", 0), ("two", 1)]
    assert learned() == pairs
    assert len(learned(rows=3)) == 3 and set(learned(rows=3)) < set(pairs)
    assert sum(len(t) for t, _ in learned(characters=9)) <= 9 and not learned(characters=1)


def test_held_out_rows_of_the_table(llm):
    held = toxicity.op12_toxicity(llm, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r.toxic for r in llm.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    tested = [(r.predicted, marks[r.doc_id]) for r in held if r.held_out and marks.get(r.doc_id) is not None]
    assert np.mean([p == t for p, t in tested]) > 0.9
