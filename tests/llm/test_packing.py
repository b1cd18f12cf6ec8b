import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandwise.llm import packing as P

ODD = ["naïve Café's don't I'll 42nd 3.14 a_b <|endoftext|> x", "ﬁ Ω İstanbul ſ 日本語 текст  em nb", "tab\tline\nform\x0cfeed", "!!! ... ?? ## ’quoted’", "a" * 5000, "<| not special |>", "'S 'T Ünïcode´s ˮ"]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(P.default_tokenizer())


def ids(full, text):
    return [*full.encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, pairs, full, capacity):
    want = Counter((i, tuple(ids(full, t))) for i, t in pairs)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {i for i, _ in pairs}
    for (doc, tokens), times in want.items():
        if sum(1 for d, _ in want if d == doc) > 1 or times > 1:
            continue  # rows that repeat an id are counted below
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(tokens)
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(tokens)
    assert sum(r.length for r in rows) == sum(len(t) * n for (_, t), n in want.items())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(r.length for r in rows))


def test_query(spark, case, full):
    folder, pairs = case
    assert verify(P.op7_packing(spark, folder).collect(), pairs, full, 2048) < 0.05


def test_many_documents_leave_little_padding(spark, full):
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choices(["alpha", "Beta", "of", "the", "x1"], k=int(rng.paretovariate(0.8) * 20) % 4000))) for i in range(1500)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert verify(P.pack(docs).collect(), pairs, full, 2048) < 0.01


def test_small_capacity(spark, full):
    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    verify(P.pack(docs, capacity=32, unit=1).collect(), pairs, full, 32)


def test_words_as_the_tokenizer_has_them(full):
    code = P.WordEncoder(P.default_tokenizer())
    rng = random.Random(6)
    alphabet = "abcXYZ019 .,'!-_éßÀÿĀſİ’“\n\t<|>#日я­\x85\xa0"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(code.text(t.encode()), dtype="<u4").tolist() == full.encode(t, add_special_tokens=False).ids, t


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        value = rng.random(n).round(2)
        best = 0.0
        for counts in itertools.product(*(range(n // (i + 1) + 1) for i in range(n))):
            if sum(c * (i + 1) for i, c in enumerate(counts)) <= n:
                best = max(best, float(np.dot(counts, value)))
        got, pattern = P.knapsack(value, n)
        assert got == pytest.approx(best) and np.dot(pattern, value) == pytest.approx(got) and np.dot(pattern, np.arange(n) + 1) <= n


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(2)
    demand = rng.integers(0, 400, 64)
    demand[24:] = 0  # with items this small, volume is nearly the linear program's bound
    out = P.column_generation(demand, 64)
    used = sum(n * p for n, p in out)
    assert (used <= demand).all() and all(np.dot(p, np.arange(64) + 1) <= 64 for _, p in out)
    rest = int(((demand - used) * (np.arange(64) + 1)).sum())
    bound = int((demand * (np.arange(64) + 1)).sum()) / 64
    assert sum(n for n, _ in out) + rest / 64 <= 1.01 * bound + 1
