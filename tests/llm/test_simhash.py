import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strandwise.llm import simhash as S

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text):
    ws = [w for w in (text or "").translate(LOWER).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(prints):
    """prints: node -> fingerprint; every pair is compared."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_query(spark, case):
    folder, pairs = case
    got = S.op3_simhash(spark, folder).collect()
    assert len(got) == len(pairs)
    # an id may have several texts, and rows may repeat
    prints = {(i, p): p for i, t in pairs if i is not None for p in [brute_print(t)]}
    groups = brute_components(prints)
    want = Counter((i, f"{p:016x}", groups[i, p][0]) for i, t in pairs if i is not None for p in [brute_print(t)])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert sorted(r.fingerprint for r in got if r.doc_id is None) == sorted(f"{brute_print(t):016x}" for i, t in pairs if i is None)


def clusters(rng, n):
    """Fingerprints in chains of few changed bits, with large groups that agree in most bits."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    return list(out)[:n]


@pytest.mark.parametrize("tile", [8192, 64])
def test_components_of_many(spark, tile):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    # a block that all share, so that keys are hot and tiles are needed
    prints = clusters(rng, 700) + list({base ^ rng.getrandbits(22) for _ in range(500)})
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp long")
    links = S.near_links(nodes, tile=tile).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in links)
    found = {r.node: r.component for r in S.components(S.near_links(nodes, tile=tile)).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_bit_sliced_distances():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    for i in range(1000):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    want = np.array([(int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True)])
    assert np.array_equal(S._unpack(S.within(S.planes(a), S.planes(b)), 1000), want)


def test_components_of_many(spark, tile):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    # a block that all share, so that keys are hot and tiles are needed
    prints = clusters(rng, 700) + list({base ^ rng.getrandbits(22) for _ in range(500)})
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp long")
    links = S.near_links(nodes, tile=tile).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in links)
    found = {r.node: r.component for r in S.components(S.near_links(nodes, tile=tile)).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_bit_sliced_distances():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    for i in range(1000):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    want = np.array([(int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True)])
    assert np.array_equal(S._unpack(S.within(S.planes(a), S.planes(b)), 1000), want)


def test_drop_keeps_one_of_each(spark, case):
    folder, pairs = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    prints = {i: brute_print(t) for i, t in pairs if i is not None}
    groups = brute_components(prints)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    assert ids.count(None) == sum(i is None for i, _ in pairs)


def test_components_of_paths_and_stars(spark):
    from strandwise.llm.components import components

    rng = random.Random(2)
    links, parent = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 400)], defaultdict(set)
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    for a, b in links:
        parent[a].add(b)
        parent[b].add(a)
    want = {}
    for start in sorted(parent):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += parent[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(rng.sample(links, len(links)), "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
