import random

import numpy as np
import pytest

from strandwise.llm import blocks as B
from strandwise.llm import nearcopies as N
from strandwise.llm.common import Stash
from tests.llm.test_nearcopies import brute_components, edited, first_rows, kept, near_rows

WORDS = N.PRINT // 64


def around(rng, base, n, most):
    """Fingerprints that differ from ``base`` in up to ``most`` bits."""
    out = np.repeat(base[None], n, axis=0)
    for row in out:
        for bit in rng.choice(64 * len(base), rng.integers(0, most + 1), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


def parts(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        p, q = label[a], label[b]
        label = [min(p, q) if x in (p, q) else x for x in label]
    return label


def brute(key, prints, radius):
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
    return [(i, j) for i in range(len(key)) for j in range(i) if key[i] == key[j] and far[i, j] <= radius]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 512])
def test_counter_counts_planes(n):
    rng = np.random.default_rng(n)
    bits = rng.random((n, 640)) < rng.random(640)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    count = bits.sum(axis=0)
    for radius in {0, 1, 4, n // 2, n - 1, n, *np.unique(count)[:5].tolist()}:
        got = np.unpackbits(B.over(words, radius).view(np.uint8), bitorder="little").astype(bool)
        assert np.array_equal(got, count > radius)


@pytest.mark.parametrize("few", [1, 3, 8])
def test_links_join_what_all_pairs_join(monkeypatch, few):
    monkeypatch.setattr(B, "FEW", few)
    rng = np.random.default_rng(2)
    key, prints = [], []
    for g, n in enumerate([1, 2, 2, 3, 4, 8, 9, 70, 1, 130]):
        for size in (n // 2, n - n // 2):  # two clusters, joined by chains or not at all
            prints.append(around(rng, rng.integers(0, 2**64, WORDS, dtype=np.uint64), size, 140))
        key += [g * 7 - 20] * n
    key, prints = np.array(key), np.concatenate(prints)
    a, b = B.links(key, prints, N.RADIUS)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    want = brute(key, prints, N.RADIUS)
    assert {tuple(sorted(p)) for p in pairs} <= {tuple(sorted(p)) for p in want}
    assert parts(len(key), pairs) == parts(len(key), want)
    assert len(want) > len(key)


def test_no_rows():
    a, b = B.links(np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64), N.RADIUS)
    assert len(a) == len(b) == 0


def test_blocks_find_what_agrees_in_one(spark):
    rng = np.random.default_rng(5)
    prints = np.concatenate([around(rng, rng.integers(0, 2**64, WORDS, dtype=np.uint64), 12, 90) for _ in range(6)])
    size = [100] * 71 + [150]
    odd = [bytes(64)] * 70 + [b"\xff" * 64] + [bytes(64)]  # parities of the last but one are those of another text
    rows = [(k * 31 - 900, size[k], odd[k], prints[k].tobytes()) for k in range(72)]
    sets = spark.createDataFrame(rows, "sign long, size int, bits binary, print binary")
    with Stash(spark) as stash:
        got = {(r.a, r.b) for r in B.block_links(sets, N.PRINT // 8, N.RADIUS, stash).collect()}
    wide = -(-((72).bit_length() + B.SPARE) // 8)
    cells = prints.view(np.uint8).reshape(72, -1)
    agree = lambda i, j: any((cells[i, k : k + wide] == cells[j, k : k + wide]).all() for k in range(0, 64 // wide * wide, wide))
    want = [(i, j) for i, j in brute([0] * 72, prints, N.RADIUS) if agree(i, j) and size[i] == size[j] and odd[i] == odd[j]]
    at = {r[0]: k for k, r in enumerate(rows)}
    assert len(want) > 200
    assert parts(72, [(at[a], at[b]) for a, b in got]) == parts(72, want)


def test_stage_meets_by_blocks_first(spark, put, monkeypatch):
    """What blocks of the fingerprints join does not meet again by shingles."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    pairs = list(enumerate(edited(rng, words, 1) for _ in range(30)))
    met = []
    real = N._candidates
    monkeypatch.setattr(N, "_candidates", lambda found: met.append(found.count()) or real(found))
    docs = spark.read.parquet(f"{put(pairs)}/documents.parquet")
    assert kept(N.drop_near_copies(docs)) == first_rows(pairs)
    assert met == [0]


@pytest.mark.parametrize("spare, most", [(0, B.MOST), (0, 10), (64, B.MOST)])
def test_result_does_not_hang_on_blocks(spark, put, monkeypatch, spare, most):
    """Wide blocks find little and narrow ones much; shingles bring the rest."""
    monkeypatch.setattr(B, "SPARE", spare)
    monkeypatch.setattr(B, "MOST", most)
    pairs = near_rows(7)
    docs = spark.read.parquet(f"{put(pairs)}/documents.parquet")
    out = N.near_copies(docs)
    groups = brute_components(pairs)
    first = {}
    for (i, _), c in groups.items():
        first[c] = min(first.get(c, i), i)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: first[c] for (i, _), c in groups.items()}
