import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandwise.llm import maxent as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END = "\x00end"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def brute(pairs):
    c = Counter(w for i, t in pairs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in pairs:
        ws = tokens(t)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_query(spark, case):
    folder, pairs = case
    got = X.op9_maxent(spark, folder).collect()
    compare(got, brute(pairs))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("most", [0, 3, 50])
def test_small_heads_give_the_same_base(spark, put, monkeypatch, most):
    from .conftest import odd_rows

    pairs = odd_rows()
    real = X.commonest
    monkeypatch.setattr(X, "commonest", lambda v: real(v, most))
    compare(X.op9_maxent(spark, put(pairs)).collect(), brute(pairs))


def test_commonest(spark):
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), 7, 1 + 1000 // (i + 1)) for i in range(2000)]
    v = spark.createDataFrame(rows, "h long, prefix int, c long")
    for most in (0, 5, 100, 1500, 5000):
        t = X.commonest(v, most)
        assert t.num_rows <= most and (most < 5000 or t.num_rows == 2000)
        if t.num_rows:
            assert min(t.column("c").to_pylist()) * 1.1 + 1 >= max(c for h, _, c in rows if h not in set(t.column("h").to_pylist())) if t.num_rows < 2000 else True


def test_probabilities_sum_to_one_and_learning_helps(spark):
    import random

    rng = random.Random(3)
    step = {w: rng.sample(range(60), 3) for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(120):
            out.append(f"{'abcdefgh'[w % 8]}{w}")
            w = rng.choice(step[w])
        return " ".join(out)

    pairs = [(i, text()) for i in range(200)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = X.scores(docs).collect()
    base = sum(r.base_score for r in got if r.held_out)
    assert sum(r.score for r in got if r.held_out) > base * 0.97
    # every class's words and its unknown share sum to one, and so do the classes
    v = X.counts(docs)
    lexicon = X.Lexicon(X.commonest(v), *v.selectExpr("sum(c)", "count(*)").first(), [tuple(r) for r in v.groupBy("prefix").agg({"c": "sum", "h": "count"}).select("prefix", "sum(c)", "count(h)").collect()])
    weights = X.Weights(lexicon, X.train(docs, lexicon))
    assert weights.chances(np.zeros((3, 5), dtype=np.int64)).sum(axis=1) == pytest.approx(np.ones(5))
    assert lexicon.mass.sum() == lexicon.n and lexicon.kinds.sum() == lexicon.v
    assert 10**lexicon.within == pytest.approx(lexicon.mass + X.ALPHA * (lexicon.kinds + 1))


def test_only_held_out_rows(spark, put):
    ids = [i for i in range(100) if held(i)][:4]
    pairs = [(i, "some words") for i in ids]
    compare(X.op9_maxent(spark, put(pairs)).collect(), brute(pairs))


def test_scores_do_not_hang_on_partitions(spark, monkeypatch):
    from .conftest import odd_rows

    monkeypatch.setattr(X, "SHARD_TOKENS", 8000)
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    one, *others = (sorted(map(tuple, X.scores(docs.repartition(n)).collect()), key=str) for n in (2, 16, 64))
    for other in others:
        assert [r[:5] for r in one] == [r[:5] for r in other]
        assert [r[6] for r in one] == pytest.approx([r[6] for r in other], rel=1e-9)


def test_shards_do_not_follow_the_partitions_of_a_shuffle(spark, monkeypatch):
    from .conftest import odd_rows

    monkeypatch.setattr(X, "SHARD_TOKENS", 8000)
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(4).cache()
    before = sorted(map(tuple, X.scores(docs).collect()), key=str)
    # a cluster that deals to many more partitions than were asked for
    frame = type(docs)
    for name in ("repartition", "repartitionById"):
        monkeypatch.setattr(frame, name, lambda self, n, *cols, f=getattr(frame, name): f(self, max(n, 40) if cols and isinstance(n, int) else n, *cols))
    after = sorted(map(tuple, X.scores(docs).collect()), key=str)
    assert [r[:5] for r in before] == [r[:5] for r in after]
    assert [r[6] for r in before] == pytest.approx([r[6] for r in after], rel=1e-9)
