import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from strandwise.llm import substring as B

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(pairs):
    """For each row whether each word goes; rows of null id keep all, rows of one id and one text are one document."""
    key = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    first, split = {}, [(i, key(t), WORD.findall(t or "")) for i, t in pairs]
    for i, k, ws in split:
        for s in range(len(ws) - 19 if i is not None else 0):
            w = tuple(ws[s : s + 20])
            first[w] = min(first.get(w, (i, s, k)), (i, s, k))
    out = []
    for i, k, ws in split:
        gone = [False] * len(ws)
        if i is not None:
            for s in range(len(ws) - 19):
                if first[tuple(ws[s : s + 20])] < (i, s, k):
                    gone[s : s + 20] = [True] * 20
        out.append((i, ws, gone))
    return out


def row(i, ws, gone):
    kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
    return i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_query(spark, case):
    folder, pairs = case
    got = B.op8_substring(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(row(*x) for x in brute(pairs))


@pytest.mark.parametrize("seed", range(4))
def test_few_words_with_many_repeats(spark, put, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b"] if seed == 0 else [f"v{i}" for i in range(3 + 10 * seed)]
    stock = [rng.choices(vocabulary, k=rng.randint(15, 60)) for _ in range(6)]
    pairs = []
    for i in range(40):
        ws = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(stock)
            a = rng.randint(0, 10)
            ws += part[a : a + rng.randint(10, 60)] if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(0, 30))
        if i % 10 == 0:
            ws += ["same"] * rng.randint(0, 70) + vocabulary[:2] * 30
        pairs.append((i * 3, rng.choice([" ", "\n", "  "]).join(ws)))
    rng.shuffle(pairs)
    got = B.op8_substring(spark, put(pairs, parts=3)).collect()
    assert Counter(map(tuple, got)) == Counter(row(*x) for x in brute(pairs))


def test_agrees_with_its_sql(spark, put):
    import duckdb

    from .conftest import odd_rows

    # the SQL takes ids as unique
    pairs = list({p[0]: p for p in odd_rows() if p[0] is not None and len(p[1] or "") < 100_000}.values())
    folder = put(pairs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = B.op8_substring(spark, folder)
    want = con.execute(B.OP8_SQL).df()[got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(want.itertuples(index=False, name=None))


def test_remove_keeps_columns_and_other_texts(spark, case):
    folder, pairs = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = B.remove_repeats(docs)
    assert out.columns == docs.columns
    want = Counter((i, t if not any(gone) else " ".join(w for w, g in zip(ws, gone, strict=True) if not g)) for (i, t), (_, ws, gone) in zip(pairs, brute(pairs), strict=True))
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    if "_spans" in docs.columns:
        assert all(r._spans.startswith("_spans") for r in rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_of_one_id_keep_what_is_their_own(spark, put, parts):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 60), ("b", 40), ("c", 30)))
    pairs = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, f"{c} {b}")]
    folder = put(pairs, parts=parts)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in B.op8_substring(spark, folder).collect())
    assert got == Counter([(1, 60, 0), (2, 60, 60), (2, 40, 0), (3, 30, 0), (3, 30, 0), (4, 70, 70)])
    kept = Counter((r.doc_id, r.text) for r in B.remove_repeats(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    assert kept == Counter([(1, a), (2, ""), (2, b), (3, c), (3, c), (4, "")])
