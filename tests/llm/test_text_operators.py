"""Encoding, packing, line dedup, language and quality against brute force."""

import collections
import hashlib
import random
import string
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skywake.llm import bpe, language, lines, packing, quality

ODD = [None, "", " ", "\n\n", "it's  we'll\t\tx", "é ñ 日本語 " * 40, "a" * 700, " " * 900, "'" * 300, "x\x1c y", "don't 'VE 12 <|endoftext|>"]


def _text(rng, size):
    return "".join(rng.choice(["word ", "two  ", "\n", "'ll", "é", "12", "!? ", "   ", "\t"]) for _ in range(size))


def test_chunks_are_encoded_as_the_whole_text(documents):
    rng = random.Random(3)
    texts = [*ODD, *(_text(rng, 400) for _ in range(30))]
    rows = list(enumerate(texts)) + [(3, texts[5]), (3, texts[5]), (None, texts[12]), (None, texts[12])]
    held = bpe.decode(bpe.encode(documents(rows), chunk=64, overlap=16)).collect()
    whole = bpe.encoding(bpe.VOCABULARY)
    expected = collections.Counter((k, np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in held) == expected
    assert bpe.encode(documents([])).count() == 0


def _pieces(packed, limit):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end <= limit
    return by_doc, by_sequence


def test_every_id_is_packed_once(documents):
    rng = random.Random(5)
    texts = [*ODD, *(_text(rng, rng.randint(1, 900)) for _ in range(60))]
    by_doc, by_sequence = _pieces(packing.pack(documents(list(enumerate(texts))).coalesce(2), tokens=128, segments=8).collect(), 128)
    whole = packing.tokenizer(packing.VOCABULARY)
    for k, text in enumerate(texts):
        rows = sorted(by_doc[k], key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in rows)
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in rows] == np.cumsum([0] + [r.length for r in rows[:-1]]).tolist()
        assert all(r.doc_tokens == len(ids) // 4 for r in rows)
    totals = [sum(r.length for r in rows) for rows in by_sequence.values()]
    assert all(t == 128 or not t & (t - 1) for t in totals)
    assert max(map(len, by_sequence.values())) <= 8
    assert packing.pack(documents([])).count() == 0


def test_every_character_beside_punctuation_has_the_tokenizers_ids():
    ours = packing.WordIds(packing.VOCABULARY, packing.END_ID)
    for marks, last in ((",.", 0x1FFFF), (string.punctuation, 0x600)):
        letters = [chr(c) for c in range(0x20, last) if not 0xD800 <= c < 0xE000]
        words = [w for c in letters for m in marks for w in (c + m, m + c, f"a{c}{m}", c)]
        whole = packing.tokenizer(packing.VOCABULARY).encode_batch_fast(words, add_special_tokens=False)
        wrong = [w for w, held, asked in zip(words, ours(words), whole, strict=True) if np.frombuffer(held, "<u4").tolist() != [*asked.ids, packing.END_ID]]
        assert not wrong


def test_ids_are_packed_for_null_ids_and_repeated_rows_and_long_texts(documents, monkeypatch):
    monkeypatch.setattr(packing, "CHARACTERS", 40)
    long = "one, two. İ, क़. three " * 130_000  # more words than are remembered together
    rows = [(None, "null id, here."), (4, "again and again"), (4, "again and again"), (5, long), (None, None)]
    whole = packing.tokenizer(packing.VOCABULARY)
    held = packing.pack(documents(rows).coalesce(1)).collect()
    _pieces(held, packing.TOKENS)
    got = collections.Counter((r.doc_id, r.doc_tokens) for r in held if r.start == 0)
    expected = [(k, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    assert got == collections.Counter((k, len(ids)) for k, ids in expected)
    pieces = sorted((r for r in held if r.doc_id == 5), key=lambda r: r.start)
    assert b"".join(bytes(r.ids) for r in pieces) == np.array(expected[3][1], "<u4").tobytes()
    assert sum(r.length for r in held) == sum(len(ids) for _, ids in expected)
    items = packing.Packer(8, 4, 8)
    items.add(1, bytes(4 * 1_000_003))
    assert len(items.items) == 1 and len(items.items[0].ids) == 4 * 3  # what waits holds its own ids alone


def test_loss_bearing_tokens_are_limited(llm):
    rows = [(k, "word " * (k % 37 + 1), k % 11 if k % 4 else None) for k in range(200)]
    held = packing.pack(llm.createDataFrame(rows, "doc_id long, text string, loss_from long"), tokens=64, segments=5, loss=20).collect()
    _, by_sequence = _pieces(held, 64)
    assert max(sum(r.n_loss for r in rows) for rows in by_sequence.values()) <= 20
    assert sum(r.n_loss for r in held) == sum(max(0, k % 37 + 2 - (p or 0)) for k, _, p in rows)


def _cleaned(rows):
    holders = collections.defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        held = (text or "").split("\n")
        mine = -1 if doc_id is None else doc_id
        kept = [x for x in held if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == mine]
        out.append((doc_id, len(held), len(held) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def _lines(rng, count, start=0):
    pool = [f"  Line NUMBER {k} with É and enough characters to count\t" for k in range(12)]
    rows = [(start + k, "\n".join(rng.choice([*pool, "short", "", "x" * 39, "own " * 20 + str(k)]) for _ in range(rng.randint(0, 9)))) for k in range(count)]
    return [*rows, (start + 1, rows[0][1]), (start + 2, rows[2][1]), (None, pool[0] + "\n" + pool[1]), (None, None), (start + 3, "")]


def _answers(index, frame):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.clean(frame).collect())


def test_lines_many_documents_share_are_dropped(llm, documents):
    rows = _lines(random.Random(1), 60)
    frame = documents(rows)
    assert _answers(lines.LineIndex.empty(llm).insert(frame), frame) == _cleaned(rows)
    empty = documents([])
    assert lines.LineIndex.empty(llm).insert(empty).clean(empty).count() == 0


def test_the_line_index_is_reversible(llm, documents):
    one, two = _lines(random.Random(1), 30), [r for r in _lines(random.Random(2), 30, 100) if r[0] is not None]
    first = lines.LineIndex.empty(llm).insert(documents(one))
    both = first.insert(documents(two))
    assert _answers(both, documents(one + two)) == _cleaned(one + two)
    assert both.insert(documents(two)).refs.count() == both.refs.count()
    back = both.delete(documents(two))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))
    assert _answers(back, documents(one)) == _cleaned(one)
    held = {bytes(r.key) for r in back.counts.collect()}
    gone = {bytes(r.key) for r in both.counts.collect()} - held
    asked = llm.createDataFrame([(bytearray(k),) for k in held | gone], "key binary")
    seen = {bytes(r.key): r.seen for r in back._seen(asked).collect()}
    assert all(seen[k] for k in held) and not all(seen[k] for k in gone)


def test_batches_and_deliveries_change_nothing(documents):
    rng = random.Random(21)
    shared = [f"this line is shared by many documents, number {k}" for k in range(6)]
    rows = [(k, "\n".join(rng.sample(shared, rng.randint(0, 4)) + [f"line of document {k} alone, which is long enough"])) for k in range(60)]
    rows += [(None, shared[0]), (None, shared[1]), (3, shared[2]), (61, None), (62, ""), (63, "\n\n")]
    docs = documents(rows)
    answers = lambda index: sorted((tuple(r) for r in index.clean(docs).collect()), key=str)
    whole = lines.LineIndex.empty(docs.sparkSession).insert(docs)
    for batches in (2, 5):
        index = lines.LineIndex.built(docs, batches)
        assert answers(index) == answers(whole)
        for part in range(3):
            again = docs.where(lines._batch(3) == part)
            index = index.delete(again.select("doc_id")).insert(again)
        assert answers(index) == answers(whole)
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, whole.counts.collect()))
        asked = index.counts.select("key").unionByName(index.counts.selectExpr("unhex('00ff') AS key").limit(1))
        assert sum(r.seen for r in index._seen(asked).collect()) >= index.counts.count()
    assert lines.LineIndex.built(documents([])).clean(documents([])).count() == 0


def test_a_cuckoo_filter_holds_what_it_was_given():
    held = lines.CuckooFilter(16)
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(90)]  # more than fit
    for key in keys:
        held.add(key)
    assert held.spare and all(k in held for k in keys)
    for key in keys[:70]:
        held.remove(key)
    assert all(k in held for k in keys[70:])
    for key in keys[70:]:
        held.remove(key)
    assert not held.slots.any() and not held.spare


def _language(rng, lang):
    words = {"aa": ["tion", "the", "and", "ing"], "bb": ["ung", "der", "und", "sch"], "cc": ["que", "les", "eau", "ment"]}[lang]
    return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80)))


def test_languages_are_told_apart(llm):
    rng = random.Random(4)
    rows = [(k, _language(rng, lang := rng.choice(["aa", "bb", "cc"])), lang) for k in range(300)]
    rows += [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (903, _language(rng, "bb").upper(), None), (None, _language(rng, "cc"), None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(True))
    found = {r.doc_id: r for r in language.predict(docs, language.learn(docs.where(~held_out)), held_out).collect()}
    assert np.mean([found[k].lang_pred == lang for k, _, lang in rows[:300] if k % 2]) > 0.97
    assert [found[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language.predict(docs, {}, held_out).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_all_of_a_long_text_tells_its_language(llm):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(4000)] for lang in ("aa", "bb", "cc")}
    usual = [1 / (n + 1) for n in range(4000)]

    def text(lang, size):
        return " ".join(rng.choices(words[lang], usual, k=size // 3))[:size]

    learned = {lang: text(lang, 60_000).encode() for lang in words}
    rows = [(0, text("aa", 5_000)), (1, text("aa", 1_200_000)), (2, text("aa", 100_000) + text("bb", 200_000)), (3, text("cc", 400_000) + text("aa", 800_000))]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in language.predict(docs, learned, F.lit(True)).collect()}
    assert [(found[k].lang_pred, found[k].rejected) for k in range(4)] == [("aa", False), ("aa", False), ("bb", False), ("aa", False)]
    assert found[1].score > 0.9


def test_quality_is_learned_from_labels(llm):
    rng = random.Random(6)
    good = [(k, _language(rng, "aa")) for k in range(150)]
    bad = [(k, " ".join(w + "%%%" for w in _language(rng, "aa").split())) for k in range(150, 220)]
    repeated = [(k, " ".join([w] * 9)) for k in range(220, 260) for w in [_language(rng, "aa").split()[0] + str(k)]]
    rows = good + bad + repeated
    docs = llm.createDataFrame([*rows, (900, None), (901, ""), (None, "x " * 50_000)], "doc_id long, text string")
    labels = llm.createDataFrame([(k, int(k < 150), 0) for k, _ in rows] + [(5000, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    held_out = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    model = quality.learn(docs, labels, ~held_out)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(found[k].predicted == (k < 150) for k, _ in rows if k % 3 == 0)
    assert len(found) == 263 and all(0 <= r.score <= 1 for r in found.values())
    assert found[900].score == found[901].score
    assert quality.learn(docs, labels.limit(0), ~held_out) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_rows_that_repeat_teach_once_and_within_the_bound(llm):
    def learned(**bounds):
        return [(r.text, r.quality) for r in quality.sample(docs, labels, F.lit(True), **bounds).collect()]

    docs = llm.createDataFrame([(1, "one")] * 30 + [(1, "other"), (2, "two"), (2, "two"), (3, "three")], "doc_id long, text string")
    labels = llm.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    pairs = [("one", 1), ("other", 1), ("three", 0), ("two", 0), ("two", 1)]
    assert sorted(learned()) == pairs
    for rows in (1, 3):
        held = learned(rows=rows)
        assert len(held) == rows and set(held) < set(pairs)
    assert 0 < sum(len(t) for t, _ in learned(characters=9)) <= 9 and not learned(characters=1)


def test_scores_are_the_softmax_of_the_mean(llm):
    rng = random.Random(9)
    model = quality.train([(_language(rng, "aa"), 1) for _ in range(20)] + [(_language(rng, "bb"), 0) for _ in range(20)], buckets=1 << 12)
    texts = [None, "", " \n", "one", "a a a a", "é ñ 日本", *(_language(rng, rng.choice(["aa", "bb", "cc"])) for _ in range(40))]
    docs = llm.createDataFrame([(k, t, "mine", 5, True) for k, t in enumerate(texts)], "doc_id long, text string, score string, predicted int, held_out boolean")
    for r in quality.score(docs, model).collect():
        found, shares = quality.features(texts[r.doc_id] or "", 1 << 12, quality.NGRAMS)
        logits = shares.astype(float) @ model.weights[found] + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), abs=1e-5)
        assert r.predicted == (r.score >= quality.THRESHOLD) and r.held_out is True
    assert quality.score(docs.limit(0), model).count() == 0


def test_the_language_is_that_of_the_smallest_size(llm):
    rng = random.Random(12)
    learned = {lang: _language(rng, lang).encode() * 5 for lang in ("aa", "bb", "cc")} | {"dd": b""}
    learned["ee"] = learned["aa"]  # equal sizes: the first language wins, and the margin is none
    rows = [(k, _language(rng, rng.choice(["aa", "bb", "cc"])) * rng.choice([1, 40]), "x", 1.0) for k in range(30)] + [(7, "und der", "x", 2.0)] * 2
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    held = language.predict(docs, learned, F.lit(True)).collect()

    def sizes(text):
        data = text.lower().encode()
        out = {}
        for lang, content in learned.items():
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)
            out[lang] = sum(len(tool.compress(data[i : i + language.PIECE])) for i in range(0, len(data), language.PIECE))
        return out

    expected = collections.Counter()
    for k, text, _, _ in rows:
        found = sizes(text)
        best = min(found, key=found.get)
        expected[k, best, best == "aa" or sorted(found.values())[1] < found[best] * (1 + language.MARGIN)] += 1
    assert collections.Counter((r.doc_id, r.lang_pred, r.rejected) for r in held) == expected
    assert language.predict(docs.limit(0), learned, F.lit(True)).count() == 0


@pytest.mark.parametrize("words", [3, 10_000])
def test_long_texts_are_scored_in_blocks_as_whole(words, monkeypatch):
    model = quality.train([("good text here", 1), ("BAD!! TEXT!!", 0)] * 5, buckets=1 << 12)
    text = " ".join(f"w{k % 700}" for k in range(words))
    whole = model.scorer()(text)
    monkeypatch.setattr(quality, "WORDS", 64)
    assert model.scorer()(text) == pytest.approx(whole, abs=1e-9)


def test_the_fold_of_an_id(llm):
    from skywake.llm.common import crc_mod

    rows = llm.createDataFrame([(7,), (123456,), (None,)], "doc_id long").select(crc_mod(F.col("doc_id"), 5).alias("m"))
    assert [r.m for r in rows.collect()] == [zlib.crc32(x) % 5 for x in (b"7", b"123456", b"")]
