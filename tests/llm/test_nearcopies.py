import random
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline as C
from strandwise.llm import nearcopies as N

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    ws = [w for w in (text or "").translate(LOWER).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(pairs):
    """Component of each (id, text); all pairs of rows are compared."""
    rows = sorted({(i, t or "") for i, t in pairs if i is not None})
    sets = {r: shingle_set(r[1]) for r in rows}
    parent = {r: r for r in rows}

    def root(r):
        while parent[r] != r:
            r = parent[r]
        return r

    for x, r in enumerate(rows):
        for s in rows[x + 1 :]:
            a, b = sets[r], sets[s]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((root(r), root(s)))
                parent[q] = p
    return {r: root(r) for r in rows}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def near_rows(seed=3):
    """Edited copies around 0.8, a large group of them, and a passage that many otherwise different texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        out += [edited(rng, base, rng.randint(0, len(base) // 25)) for _ in range(3)]
    base = rng.choices(vocabulary, k=200)
    out += [edited(rng, base, rng.randint(1, 5)) for _ in range(90)]
    passage = rng.choices(vocabulary, k=50)
    out += [" ".join([*passage, *rng.choices(vocabulary, k=rng.randint(5, 60))]) for _ in range(90)]
    rng.shuffle(out)
    return list(enumerate(out))


def first_rows(pairs):
    """The row of each component that stays: of its smallest id, the text that hashes lowest."""
    key = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42) if t else 42) - (h >> 63 << 64)
    groups = brute_components(pairs)
    least = {}
    for (i, t), c in groups.items():
        least[c] = min(least.get(c, (i, key(t), t)), (i, key(t), t))
    return sorted((i, t) for i, _, t in least.values())


def kept(out):
    return sorted((r.doc_id, r.text or "") for r in out.select("doc_id", "text").where("doc_id is not null").collect())


def test_stage_drops_edited_copies(spark, put):
    pairs = near_rows()
    folder = put(pairs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    groups = brute_components(pairs)
    assert len(groups) - len(set(groups.values())) > 90
    assert kept(C.near_dedup(spark, docs, folder)) == first_rows(pairs)


@pytest.mark.parametrize("hot", [64, 2])
def test_odd_rows(spark, case, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    folder, pairs = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = N.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert kept(out) == first_rows(pairs)
    assert out.where("doc_id is null").count() == sum(i is None for i, _ in pairs)


def test_rows_of_one_id(spark, put):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    pairs = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " more"), (4, b)]
    docs = spark.read.parquet(f"{put(pairs)}/documents.parquet")
    assert len(kept(N.drop_near_copies(docs))) == 3
    assert kept(N.drop_near_copies(docs)) == first_rows(pairs)


@pytest.mark.parametrize("tile", [1500, 4000])
def test_components_are_cut_into_tiles(spark, put, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    real, seen = N._tiled, []
    monkeypatch.setattr(N, "_tiled", lambda g: seen.append((g, out := real(g))) or out)
    held = []

    def checked(tiled, docs, check=N._checked):
        groups = seen[0][0].select("sign", "size").collect()
        size = {r.sign: r.size for r in groups}
        tasks = {}
        for r in tiled.collect():
            for m in r.meet:
                tasks[m] = tasks.get(m, 0) + size[r.sign]
        held.extend([sum(size.values()), *tasks.values()])
        return check(tiled, docs)

    monkeypatch.setattr(N, "_checked", checked)
    pairs = near_rows()
    docs = spark.read.parquet(f"{put(pairs)}/documents.parquet")
    assert kept(C.near_dedup(spark, docs, None)) == first_rows(pairs)
    # two tiles a task, which hashes fill unevenly
    assert max(held[1:]) < 4 * tile < held[0]


def _sets(texts):
    s = N.Shingles([t.encode() for t in texts])
    return s, s.size, s.bitmaps(), s.prints()


def test_long_unrelated_texts_are_no_candidates():
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(10)]
    texts = [" ".join([*shared, *(f"w{rng.randrange(10**6)}" for _ in range(4000 + k))]) for k in range(6)]
    _, size, bits, prints = _sets(texts)
    assert N.forest(size, bits, prints) == []


def test_fingerprints_of_near_copies_are_within_the_radius():
    rng = random.Random(4)
    texts = []
    for n in [N.LONG + 4, 80, 100, 150, 300, 1000, 5000] * 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        cut = (n - 4) // 9  # as many words go at one end as come at the other: a similarity of 0.8
        texts += [" ".join(words), " ".join([*words[cut:], *(f"x{rng.randrange(10**6)}" for _ in range(cut))])]
    s, size, bits, prints = _sets(texts)
    far = np.bitwise_count(prints[::2] ^ prints[1::2]).sum(axis=1)
    assert far.min() > 0 and far.max() <= N.RADIUS
    other = np.bitwise_count(prints[::2] ^ np.roll(prints[1::2], 1, axis=0)).sum(axis=1)
    assert other.min() > N.RADIUS
    # a bit is the vote of the set's shingles
    h = s.h[: size[0]]
    first = N._mix(h + np.uint64(0x9E3779B97F4A7C15))
    votes = np.unpackbits(first.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    assert np.array_equal(np.unpackbits(prints[0].view(np.uint8))[:64], 2 * votes > size[0])


def test_stored_tables_are_smaller_than_the_texts(spark, put, monkeypatch):
    rng = random.Random(6)
    pairs = [(i, " ".join(f"word{rng.randrange(10**5)}" for _ in range(2000))) for i in range(200)]
    docs = spark.read.parquet(f"{put(pairs)}/documents.parquet")
    real, sizes = N.Stash.put, []

    def measured(self, df, *more):
        out = real(self, df, *more)
        top = Path(self.top.removeprefix("file:"))
        sizes.append(sum(f.stat().st_size for f in top.rglob("*.parquet")))
        return out

    monkeypatch.setattr(N.Stash, "put", measured)
    assert N.near_copies(docs).where("first").count() == 200
    assert 0 < max(sizes) < 0.6 * sum(len(t) for _, t in pairs)
