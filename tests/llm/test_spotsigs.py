import hashlib
import itertools
import random

import pytest
import regex

from strandwise.llm import spotsigs as P


def signs(text):
    lower = text.lower()
    ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", lower) if w]
    content = [(i, w) for i, w in enumerate(ws) if w not in P.ANCHORS]
    out = set()
    for i, w in enumerate(ws):
        after = [x for j, x in content if j > i][: P.CHAIN] if w in P.ANCHORS else []
        if len(after) == P.CHAIN:
            out.add((w, *after))
    if not out and len(ws) >= P.CHAIN:
        out = {("*", *ws[i : i + P.CHAIN]) for i in range(len(ws) - P.CHAIN + 1)}
    return out or {("=", " ".join(ws), lower)}


def share(a, b):
    return len(a & b) / len(a | b)


def edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_query(spark, case):
    folder, pairs = case
    got = P.op4_spotsigs(spark, folder).collect()
    assert len(got) == len(pairs)
    known = sorted((i, t or "") for i, t in pairs if i is not None)[::-1]
    free = [t or "" for i, t in pairs if i is None]
    orders = [[*known, *((None, t) for t in p)] for p in itertools.permutations(free)]

    def rows(order):
        out = []
        for k, (i, t) in enumerate(order):
            n = order[(k + 1) % len(order)][1]
            e = edit(t, n)
            a = signs(t)
            out.append((i is None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), round(share(a, signs(e)), 9), round(share(a, signs(n)), 9)))
        return sorted(out)

    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert mine in [rows(o) for o in orders]
    texts = dict(pairs)
    prints = {}
    for r in got:
        if r.doc_id is not None:
            prints.setdefault(frozenset(signs(texts[r.doc_id] or "")), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_one_row_and_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "the quick brown fox of old")], "doc_id long, text string")
    r = P.fingerprints(docs).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(edit("the quick brown fox of old", "the quick brown fox of old").encode()).hexdigest()
    docs = spark.createDataFrame([(5, "a b"), (5, "c d"), (5, "c d"), (None, None)], "doc_id long, text string")
    assert P.fingerprints(docs).count() == 4


@pytest.mark.parametrize("alone", [1, 10])
def test_following(spark, alone):
    rng = random.Random(alone)
    values = sorted(rng.sample(range(-(10**9), 10**9), 300), reverse=True)
    ids = spark.createDataFrame([(v,) for v in values], "g long")
    got = {r.g: r.next_g for r in P.following(ids, alone=alone, width=4).collect()}
    assert got == dict(zip(values, [*values[1:], values[0]], strict=True))


def test_only_native_plan(spark, put):
    from .conftest import odd_rows

    plan = P.op4_spotsigs(spark, put(odd_rows()))._jdf.queryExecution().toString()
    assert not regex.search("Python|Pandas|Arrow|BatchEval", plan)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_pairs(spark, threshold):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(60)] + ["the", "of", "and", "is"] * 8
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(0, 120))
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = P.near_pairs(docs, threshold)
    of = {r.doc_id: r["class"] for r in members.collect()}
    sets = [signs(t) for t in texts]
    assert of == {i: next(j for j in range(len(sets)) if sets[j] == s) for i, s in enumerate(sets)}
    heads = sorted(set(of.values()))
    want = {(i, j): share(sets[i], sets[j]) for i in heads for j in heads if i < j and share(sets[i], sets[j]) >= threshold}
    got = [((min(r.a, r.b), max(r.a, r.b)), r.likeness) for r in pairs.collect()]
    assert len(got) == len(dict(got)) and dict(got) == pytest.approx(want)


def test_texts_of_one_id_descend_like_the_ids(spark, put):
    a, b = "aa bb cc dd", "ee ff gg hh"
    got = P.op4_spotsigs(spark, put([(2, a), (2, b), (1, "ii jj kk")])).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = [b, a, "ii jj kk"]
    want = [sha(edit(t, order[(k + 1) % 3])) for k, t in enumerate(order)]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
