"""Near duplicates, repeats, embeddings and search against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywake.llm import graph, gridjoin, neardup, suffixes, topk
from skywake.llm.graph import components, star


def _classes(count, pairs):
    parent = list(range(count))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(k) for k in range(count)]


def test_small_tables_in_loops_take_no_broadcast(llm, documents):
    shown = lambda df: llm._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    edges = llm.createDataFrame([(2, 1), (3, 2), (3, 3)], "u long, v long")
    found = neardup.near_duplicates(documents([(1, "one two three four five six"), (2, "one two three four five six"), (3, None)]))
    for df in (star(edges), found):
        df.collect()
        assert "Broadcast" not in shown(df) and "SortMergeJoin" in shown(df)


def test_components(llm):
    rng = random.Random(2)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)]
    found = dict(components(llm.createDataFrame(pairs, "a long, b long")).collect())
    expected = _classes(400, pairs)
    assert found == {k: expected[k] for pair in pairs for k in pair}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_few_edges_are_flat_in_one_step_and_many_by_parts(llm, monkeypatch, kind):
    steps, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: steps.append(label) or real(df, label))
    name = int if kind == "long" else "n{:04d}".format
    edges = [(name(k), name(k + 1)) for k in range(1000, 1060)] + [(name(2000), name(2000))]
    expected = {name(k): name(1000) for k in range(1000, 1061)} | {name(2000): name(2000)}
    for most, least, longest in ((1 << 18, 2, 2), (40, 3, 12)):
        monkeypatch.setattr(graph, "EDGES", most)
        steps.clear()
        assert dict(components(llm.createDataFrame(edges, f"a {kind}, b {kind}")).collect()) == expected
        assert least <= len(steps) <= longest


def test_probability_jaccard():
    def plain(a, b):
        x, y = collections.Counter(a), collections.Counter(b)
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x.keys() & y.keys())

    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(9) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert neardup.probability_jaccard(np.array(a, np.uint64), np.array(b, np.uint64)) == pytest.approx(plain(a, b))


def test_registers_agree_as_often_as_shingles_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    wa, wb = np.ones(400), np.ones(400)
    wa[:50] = wb[:50] = 7
    held = neardup.registers(np.repeat([0, 1], 400), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4_096)
    exact = neardup.probability_jaccard(np.repeat(a, wa.astype(int)), np.repeat(b, wb.astype(int)))
    assert abs((held[0] == held[1]).mean() - exact) < 0.03
    alone = neardup.registers(np.zeros(400, int), b, wb, 1, 4_096)
    assert (alone[0] == held[1]).all()  # whatever else is in the batch


def _near(rng):
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), rng.choice([" ", "\n", " , "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "One two"), (1004, "one TWO"), (1005, None), (1006, "w " * 3000)]
    return rows


def test_near_duplicates_are_one_class(documents):
    rows = _near(random.Random(9)) + [(1004, "one TWO"), (1003, "w1 w2 w3 w4 w5 w6"), (None, "one two")]
    held = [neardup.shingles(neardup.words(t)) for _, t in rows]
    pairs = [(i, k) for i in range(len(rows)) for k in range(i) if len(held[i]) and neardup.probability_jaccard(held[i], held[k]) >= 0.8]
    top = _classes(len(rows), pairs)
    least = {}
    for (doc_id, _), t in zip(rows, top, strict=True):
        ids = [x for x in (least.get(t), doc_id) if x is not None]
        least[t] = min(ids, default=None)
    expected = collections.Counter((doc_id, least[t], doc_id == least[t]) for (doc_id, _), t in zip(rows, top, strict=True))
    found = neardup.near_duplicates(documents(rows)).select("doc_id", "class_id", "kept").collect()
    assert collections.Counter(map(tuple, found)) == expected
    assert neardup.near_duplicates(documents([])).count() == 0


def test_texts_that_are_not_alike_enough_are_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 6)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.choice([1, 6, 9, 12])):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k + 10, " ".join(words)))
    called = []
    compared = neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda *a: called.append(1) or compared(*a))
    held = [neardup.shingles(neardup.words(t)) for _, t in rows]
    pairs = [(i, k) for i in range(len(rows)) for k in range(i) if neardup.probability_jaccard(held[i], held[k]) >= 0.8]
    expected = {doc_id: t + 10 for (doc_id, _), t in zip(rows, _classes(len(rows), pairs), strict=True)}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(rows)).collect()} == expected
    assert called and 1 < len(set(expected.values())) < 70


def _without(rows, length):
    seen, out = set(), {}
    for doc_id, data in sorted({(-1 if k is None else k, t.encode()) for k, t in rows}):
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out[doc_id, data] = (len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("split", [1 << 22, 300])
def test_repeated_strings_are_removed(documents, split):
    rng = random.Random(11)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(20, 200))) for _ in range(6)]
    rows = [(k, "".join(rng.choice([*passages, "".join(rng.choices("abcdefgh", k=30))]) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    rows += [(100, "ab" * 200), (101, "ab" * 100), (102, "a" * 300), (103, ""), (104, rows[5][1]), (104, rows[5][1]), (None, passages[0] * 2)]
    held = suffixes.without_repeats(documents([*rows, (200, None)]), 24, shard=2_000, split=split).collect()
    expected = _without([*rows, (200, "")], 24)
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in held)
    assert found == collections.Counter((k, *expected[-1 if k is None else k, t.encode()]) for k, t in [*rows, (200, "")])
    assert all(r.text == bytes(r.kept).decode(errors="ignore") for r in held)
    assert suffixes.without_repeats(documents([])).count() == 0


def test_a_passage_in_many_texts_is_dealt_to_small_groups(documents):
    rng = random.Random(31)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = some(90)
    rows = [(k, some(rng.randint(60, 150)) + passage + some(rng.randint(60, 150))) for k in range(700)]
    docs = documents(rows).selectExpr("doc_id AS did", "xxhash64(text) AS tag", "text")
    split, length = 8_000, suffixes.LENGTH
    found = suffixes._occurrences(docs, length)
    different, _ = suffixes._collapsed(found, length)
    segments = suffixes.written(suffixes._bodies(docs, different, length), "segments")
    sizes = lambda frame: frame.groupBy("mini").agg(F.sum(F.octet_length("body")).alias("n")).agg(F.max("n")).first()[0] or 0
    assert sizes(segments) > 5 * split
    levels = [sizes(here) for here, _, _ in suffixes._levels(segments, length, split)]
    assert len(levels) > 1 and max(levels) <= split
    left = suffixes.without_repeats(documents(rows), split=split).collect()
    assert {r.n_removed for r in left} == {0}  # no string of 100 bytes repeats
    longer = [some(n) for n in (99, 100, 130)]
    rows = [(k, some(rng.randint(0, 40)) + passage + some(rng.randint(0, 30)) + rng.choice([passage, some(3), *longer]) + some(rng.randint(0, 40))) for k in range(90)]
    expected = _without(rows, length)
    held = suffixes.without_repeats(documents(rows), split=2_000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in held} == {k: tuple(expected[k, t.encode()]) for k, t in rows}
    assert sum(r.n_removed > 0 for r in held) > 10


def test_segments_without_an_equal_window_are_left_out_and_no_others():
    rng = random.Random(9)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for length, size in ((suffixes.LENGTH, 40), (64, 40), (50, 40)):
        rows = []
        for _ in range(60):
            passage = line(length + rng.randint(0, 30))
            gram = passage[length // 2 - size // 2 :][:size]
            rows += [(line(rng.randint(0, 80)) + passage[rng.randint(0, 9) :] + line(rng.randint(0, 80))).encode() for _ in range(rng.randint(1, 4))]
            rows += [(line(length) + gram + line(length)).encode() for _ in range(2)]  # the gram alone is shared
        held = {}
        for number, mini, start, n in zip(*(np.concatenate(c).tolist() for c in zip(*suffixes.minimizer_runs(rows, length)))):
            body = rows[number][start : start + n + length - 1]
            held.setdefault(mini, {}).setdefault(body, (np.uint64(mini).astype(np.int64).item(), (number, 0, start, body)))
        several = [entry for bodies in held.values() if len(bodies) > 1 for entry in bodies.values()]
        whole = [row for _, row in several]
        left = suffixes.likely([mini for mini, _ in several], whole, length)
        windows = collections.Counter((mini, w) for mini, row in several for w in {row[3][i : i + length] for i in range(len(row[3]) - length + 1)})
        need = [row for mini, row in several if any(windows[mini, row[3][i : i + length]] > 1 for i in range(len(row[3]) - length + 1))]
        assert set(need) <= set(left) and (length != suffixes.LENGTH or 0 < len(left) < len(whole))
        assert suffixes.repeated(left, length) == suffixes.repeated(whole, length)


def test_windows_of_many_short_texts_are_looked_at_together(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc", k=rng.choice([0, 99, 100, 101, 180, 700]))).encode() for _ in range(200)]
    calls = []
    grams = suffixes.grams
    monkeypatch.setattr(suffixes, "grams", lambda data, *more: calls.append(len(data)) or grams(data, *more))
    together = [np.concatenate(c) for c in zip(*suffixes.minimizer_runs(texts))]
    assert len(calls) == 1
    alone = [[np.full_like(found[0], k), *found[1:]] for k, text in enumerate(texts) for found in suffixes.minimizer_runs([text])]
    assert all((a == np.concatenate(b)).all() for a, b in zip(together, zip(*alone)))
    assert [sum(together[3][together[0] == k]) for k in range(len(texts))] == [max(0, len(t) - 99) for t in texts]


def test_the_collection_transform_is_that_of_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(30):
        docs = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        symbols, prefixes, _ = suffixes.transform(docs)
        order = sorted((d[at:], k, d[at - 1] if at else suffixes.END) for k, d in enumerate(docs) for at in range(len(d) + 1))
        # equal suffixes stand in the order of what precedes their documents' ends
        assert collections.Counter(symbols.tolist()) == collections.Counter(o[2] for o in order)
        texts = [o[0] for o in order]
        common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:])]
        assert sorted(prefixes.tolist()) == sorted(common)


def _vectors(rng):
    rows = []
    for k in range(300):
        base = rng.choice(10, 1)[0]
        x = np.eye(12)[base] + rng.normal(0, 0.12, 12)
        rows.append((k, [float(v) for v in np.float32(x)], None if k % 41 == 0 else int(base % 3)))
    rows += [(300 + k, rows[3][1], rows[3][2]) for k in range(20)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 12, 1), (403, [None] + [1.0] * 11, 1), (404, [float("nan")] * 12, 1), (405, [float("inf")] + [0.0] * 11, 1),
             (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, rows[5][1], None), (7, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2])]
    return rows


def _usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x)


def test_vectors_within_an_angle_are_linked(llm):
    rows = _vectors(np.random.default_rng(5))
    schema = "vec_id long, embedding array<float>, label int, copies int"
    frame = llm.createDataFrame([(*r, 0) for r in rows], schema)
    unit = [np.array(x) / np.linalg.norm(x) if _usable(x) and any(x) and y is not None else None for _, x, y in rows]
    pairs = [
        (i, k) for i in range(len(rows)) for k in range(i)
        if unit[i] is not None and unit[k] is not None and len(unit[i]) == len(unit[k]) and rows[i][2] == rows[k][2] and unit[i] @ unit[k] >= 0.93
    ]
    links = collections.Counter(x for p in pairs for x in p)
    top = _classes(len(rows), pairs)
    least = {}
    for r, t in zip(rows, top, strict=True):
        least[t] = min([x for x in (least.get(t), r[0]) if x is not None], default=None)
    expected = collections.Counter((r[0], links[k], least[t], r[0] == least[t]) for k, (r, t) in enumerate(zip(rows, top, strict=True)))
    for block in (7, 512):
        found = gridjoin.near_duplicates(frame, block=block).collect()
        assert collections.Counter(map(tuple, found)) == expected
    assert gridjoin.near_duplicates(frame.limit(0)).count() == 0


def test_distant_blocks_are_skipped(llm):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in np.eye(6)[k % 6] + rng.normal(0, 0.02, 6)], 1) for k in range(600)]
    held = gridjoin.keyed(llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert held.where("vkey IS NULL").count() == 0
    one = gridjoin.classes(held)
    axes = gridjoin.directions(one)
    placed = []
    for r in one.collect():
        at = gridjoin.unit(r.embedding) @ axes[6]
        placed.append(at)
    assert np.ptp(np.array(placed), axis=0).min() > 0.374  # the axes tell the groups apart


@pytest.mark.parametrize("scale", [1, 500_000])
def test_the_best_are_found_exactly(llm, monkeypatch, scale):
    monkeypatch.setattr(topk, "VECTORS", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = [(k, None if x is None else [None if v is None else v * scale for v in x], y) for k, x, y in _vectors(np.random.default_rng(6))]
    frame = llm.createDataFrame([(k, x, y, "c") for k, x, y in rows], "vec_id long, embedding array<double>, label int, rank string")
    held = [(k, [int(np.floor(256 * float(c))) for c in x]) for k, x, _ in rows if k is not None and (_usable(x) or x == [])]
    expected = []
    for n, (q, asked) in enumerate(held):
        if q % 50 == 0 or q == 401:
            scores = sorted((-sum(a * b for a, b in zip(asked, v)), k) for m, (k, v) in enumerate(held) if m != n and len(v) == len(asked))
            expected += [(q, rank, k, -s) for rank, (s, k) in enumerate(scores[:5], 1)]
    found = topk.top_k(frame, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 401), bins=64 if scale == 1 else 1024)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_rows_that_share_an_id_are_candidates_each_and_huge_vectors_take_no_part(llm):
    rows = [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (50, [1.5, 0.0]), (7, [1e12, 0.0]), (8, [1e300, 1.0]), (9, [-4e6, 4e6]), (None, [9.0, 9.0])]
    frame = llm.createDataFrame([(k, x, 1) for k, x in rows], "vec_id long, embedding array<double>, row int")
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    x = lambda v: int(256 * v)
    first = [(50, 1, 1, x(1) * x(3)), (50, 2, 1, x(1) * x(2)), (50, 3, 50, x(1) * x(1.5)), (50, 4, 9, x(1) * x(-4e6))]
    second = [(50, 1, 1, x(1.5) * x(3)), (50, 2, 1, x(1.5) * x(2)), (50, 3, 50, x(1.5)  * x(1)), (50, 4, 9, x(1.5) * x(-4e6))]
    assert sorted(map(tuple, found)) == sorted(first + second)


def test_a_label_does_not_run_into_the_vector(llm):
    rows = [(1, [2.0], "a|1.0"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a"), (4, [2.0], "a|1.0"), (5, [2.0], None)]
    frame = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in gridjoin.near_duplicates(frame).collect()}
    assert found == {1: (1, 1), 4: (1, 1), 2: (1, 2), 3: (1, 2), 5: (0, 5)}
