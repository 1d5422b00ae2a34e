"""The pipeline's stages one by one."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from skywake.llm import neardup, packing


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choices(["tion", "the", "and", "ing", "or"], k=rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, passage = line(14), line(60)
    rows = []
    for k in range(90):
        rows.append((k, "\n".join([line(40), line(30)] + ([shared] if k % 4 == 0 else []) + ([passage] if k % 9 == 0 else []))))
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(110 + k, rows[k][1].replace("the", "thé", 1)) for k in range(5, 10)]
    rows += [(200 + k, " ".join(w + "%%%" for w in line(50).split())) for k in range(40)]
    rows += [(300, None), (301, ""), (None, line(40)), (3, rows[3][1])]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows),
                      "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), "kept": ["clash"] * len(rows)})
    pq.write_table(table, path / "documents.parquet")
    labels = [(r[0], int(not 200 <= r[0] < 300)) for r in rows if r[0] is not None and r[0] < 250 and r[0] % 3]
    pq.write_table(pa.table({"doc_id": [a for a, _ in labels], "quality": [b for _, b in labels], "toxic": [0] * len(labels)}), path / "labels.parquet")
    return path, rows, shared, passage


def test_stages_in_turn(llm, folder):
    path, rows, shared, passage = folder
    docs = llm.read.parquet(f"{path}/documents.parquet")
    held = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(llm, docs, str(path)), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        held.append((before.collect(), docs.collect()))
    good, lined, single, cleaned = ({(r.doc_id, r.text): r for r in after} for _, after in held)
    clean = {k for k, _ in rows if k is not None and k < 200} | {None}
    assert clean <= {k for k, _ in good} and not any(k is not None and 200 <= k < 300 for k, _ in good)
    assert len(held[0][1]) == len([r for r in rows if r[0] is None or not 200 <= r[0] < 300])
    assert sum(shared in (text or "").split("\n") for _, text in lined) == 1
    assert len(held[1][1]) == len(held[0][1])
    assert not {100, 101, 102, 103, 104} & {k for k, _ in single} and sum(k == 3 for k, _ in single) == 1
    for a in single.values():
        for b in single.values():
            x, y = (neardup.shingles(neardup.words(r.text)) for r in (a, b))
            assert a is b or not len(x) or neardup.probability_jaccard(x, y) < 0.8
    assert sum(passage in r.text for r in cleaned.values()) == 1 and len(cleaned) == len(single)
    assert all(r.n_chars == len(r.text) for r in cleaned.values())


def test_the_pipeline_packs_what_stays(llm, folder):
    path, *_ = folder
    packed = corpus_pipeline.run(llm, str(path)).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert max(np.unique([r.sequence_id for r in packed], return_counts=True)[1]) <= packing.SEGMENTS
