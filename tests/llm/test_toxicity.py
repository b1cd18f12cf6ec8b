import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import toxicity as T


def held(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 5 == 0


def test_query(spark, case):
    folder, pairs = case
    got = T.op10_toxicity(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out) for r in got) == sorted((i is None, i or 0, held(i)) for i, _ in pairs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by, texts = {}, {}
    for i, t in pairs:
        texts[i] = t if texts.setdefault(i, t) == t else ...  # an id of several texts
    for r in got:
        if r.doc_id is not None and texts[r.doc_id] is not ...:
            assert by.setdefault(texts[r.doc_id] or "", r.score) == pytest.approx(r.score)


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("aeioumnrst", k=rng.randint(3, 8))) for _ in range(300)]
    rude = ["zwxgrob", "kvackish", "blorfing", "dratzle"]
    out = []
    for i in range(n):
        ws = rng.choices(clean, k=rng.randint(20, 80))
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            ws[rng.randrange(len(ws))] = rng.choice(rude)
        out.append((" ".join(ws), toxic))
    return out


def test_held_out_accuracy_and_misspellings(spark, put):
    rows = corpus(800, 1)
    labels = pa.table({"doc_id": pa.array(range(800), pa.int64()), "toxic": pa.array([t for _, t in rows], pa.int64())})
    folder = put([(i, t) for i, (t, _) in enumerate(rows)], labels=labels)
    got = [r for r in T.op10_toxicity(spark, folder).collect() if r.held_out]
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in got]) > 0.95
    model = T.fit([t.encode() for t, _ in rows], np.array([y for _, y in rows]))
    plain, odd = "some words of text aeroin", "some kvackissh words of dratzzle text blorffing aeroin"
    assert model.score([odd.encode()])[0] > 3 * model.score([plain.encode()])[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = T.drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and np.mean([(i in kept) != bool(t) for i, (_, t) in enumerate(rows)]) > 0.97


def test_scores_do_not_depend_on_the_batch():
    rows = corpus(60, 2)
    model = T.fit([t.encode() for t, _ in rows], np.array([y for _, y in rows]))
    docs = [b"", b"a", b"ab", *(t.encode() for t, _ in rows), b"x" * 50_000]
    assert model.score(docs) == pytest.approx(np.concatenate([model.score([d]) for d in docs]))


def test_one_class_or_none():
    assert T.fit([], np.zeros(0)).score([b"x"]) == pytest.approx([0.5])
    assert T.fit([b"x", b"y"], np.array([0, 0])).score([b"x"])[0] < 0.01
