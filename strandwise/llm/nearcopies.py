"""Near copies by SimHash and Jaccard similarity of five-word shingles.

Two texts are near copies where their sets of ``SHINGLE``-word shingles (A-Z
folded, parted by white space) have a similarity of 0.8 at least; near copies
of near copies are one component. Sets whose SimHash fingerprints agree in a
block meet first and are compared bit-sliced (``blocks``). At the radius that a
similarity of 0.8 needs, some pairs agree in no block, so what blocks have not
joined meets exactly: sets of similarity 0.8 share a shingle among the first
``n - ceil(0.8 n) + 1`` of each under one order of all shingles (prefix filter),
so every such pair meets under a shingle, and a shingle is looked at unless
blocks have joined all sets that hold it. The order is by hash, with shingles
that many prefixes hold put last; which ones are put last, and what blocks have
joined, changes the work and not the result.

Sets that meet under a shingle are compared by size, by a bitmap of parities and by SimHash. The
bitmap's differing bits are at most the shingles that differ; it tells much of
short sets and nothing of long ones. The SimHash fingerprint (``PRINT`` bits, a
majority vote of the set's shingles) tells the same for all lengths: of two sets
of similarity 0.8 with ``LONG`` shingles or more, a bit differs with a chance of
0.154 at most, so more than ``RADIUS`` bits differ with one below 1e-14, while
unrelated sets differ in half of them. What is near by all three is checked on
whole sets.

Texts are read three times, and a fourth time where they may be near: their sets
would take more room than they do, and are not stored. Equal sets are one node
before anything is compared. Prefix shingles of one set only are dropped by
counting alone. Only a spanning forest of what may be near leaves a task. Each
component of these links is then gathered with its whole sets and joined anew by
exact similarities. A component of more than ``TILE`` shingles is cut into tiles
by hash, and every two tiles meet in a task; so a task holds two tiles (or two
sets, if those are longer) however large a component is, and no pair is lost.

Texts under five words are one shingle; null and empty texts have none and are
equal. A null id takes no part. Rows of one id are told apart by their texts,
and of rows that repeat both one stays. Empty tables give no rows; columns of
other names pass by.

The 64 bits and the radius of four that ``op3`` is given link a twelfth of such
pairs. So that operator serves its own query, and this one, with more bits and a
check, the pipeline's stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_links
from .common import Stash, cut, map_texts, release, spread, texts
from .components import components
from .substring import _BASE, Rolling, Words, _mix

SHINGLE = 5
#: Shingles of so many prefixes are put last in the order, the ``LAST`` commonest of them at most.
HOT = 64
LAST = 1 << 20
#: Bits of the parity bitmap of a set.
BITS = 512
WIDE = 1 << 16
#: Bits of a SimHash fingerprint, those that may differ, and the size of the sets for which that holds.
PRINT = 512
RADIUS = 154
LONG = 64
#: Shingles of a tile; a component with more is cut.
TILE = 1 << 21
#: Bytes of the wide bitmaps that a task holds.
WIDE_BYTES = 32 << 20
_SETS = 1024
_VOTES = 1 << 14
_SLICE = 2 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Shingles:
    """Sets of a slice of documents, end to end: hashes in ascending order, document, first, size, sign of each set."""

    def __init__(self, docs: list[bytes]):
        words = Words([t.translate(_LOWER) for t in docs])
        n = np.where(words.count > 0, np.maximum(words.count - SHINGLE + 1, 1), 0)
        doc = np.repeat(np.arange(len(docs)), n)
        at = words.first[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end = np.minimum(at + SHINGLE, (words.first + words.count)[doc])
        h = Rolling(words.hashes, _BASE[1]).span(at, end)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        own = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        self.h, self.doc = h[own], doc[own]
        self.size = np.bincount(self.doc, minlength=len(docs))
        self.first = np.cumsum(self.size) - self.size
        self.sign = np.zeros(len(docs), dtype=np.uint64)
        np.add.at(self.sign, self.doc, _mix(self.h))

    def once(self) -> np.ndarray:
        """Marks the sets that no earlier document of the slice has."""
        out = np.zeros(len(self.sign), dtype=bool)
        out[np.unique(self.sign, return_index=True)[1]] = True
        return out

    def cells(self) -> list[bytes]:
        """The hashes of each set as bytes."""
        return [self.h[a : a + n].tobytes() for a, n in zip(self.first, self.size, strict=True)]

    def bitmaps(self) -> np.ndarray:
        """A row of ``BITS`` / 64 words for each set; a bit is the parity of the shingles that fall on it."""
        out = np.zeros((len(self.size), BITS // 64), dtype=np.uint64)
        ends = np.r_[self.first, len(self.h)]
        for a in range(0, len(out), _SETS):
            b = min(a + _SETS, len(out))
            own = slice(ends[a], ends[b])
            cell = (self.doc[own] - a) * BITS + (self.h[own] >> np.uint64(7) & np.uint64(BITS - 1)).astype(np.int64)
            odd = (np.bincount(cell, minlength=(b - a) * BITS) & 1).astype(np.uint8)
            out[a:b] = np.packbits(odd.reshape(-1, BITS), axis=1).view(np.uint64)
        return out

    def prints(self) -> np.ndarray:
        """A row of ``PRINT`` / 64 words for each set: its SimHash, a bit is set where over half of the shingles have it."""
        votes = np.zeros((len(self.size), PRINT), dtype=np.int32)
        for a in range(0, len(self.h), _VOTES):
            h, doc = self.h[a : a + _VOTES], self.doc[a : a + _VOTES]
            each = np.stack([_mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(PRINT // 64)], axis=1)
            bits = np.unpackbits(each.view(np.uint8), axis=1).view(np.uint64)
            # eight votes to a word, each of a byte that 255 shingles can not overflow
            begin = np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1]
            length = np.diff(np.r_[begin, len(doc)])
            parts = -(-length // 255)
            at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            eight = np.add.reduceat(bits, at, axis=0).view(np.uint8)
            votes[doc[begin]] += np.add.reduceat(eight, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
        return np.packbits(2 * votes > self.size[:, None], axis=1).view(np.uint64)


def prefixes(h: np.ndarray, size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sets of the prefix shingles of sets laid end to end (``h``, ascending in each); those in ``last`` (ascending) come after all others."""
    late = np.zeros(len(h), dtype=bool)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
    first, own = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    early = np.r_[0, np.cumsum(~late)]
    before = early[:-1] - early[first][own]
    rank = np.where(late, (early[first + size] - early[first])[own] + np.arange(len(h)) - first[own] - before, before)
    at = np.flatnonzero(rank < (size - needed(size) + 1)[own])
    return at, own[at]


def needed(size):
    """Shingles that a set of similarity 0.8 must share with one of ``size``."""
    return -(-4 * size // 5)


def _prefixes(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """h, sign of every prefix shingle, once for equal sets of a slice; docs: text."""

    def work(batch):
        sets = Shingles(texts(batch))
        at, own = prefixes(sets.h, sets.size, last)
        use = sets.once()[own]
        return sets.h[at[use]].view(np.int64), sets.sign[own[use]].view(np.int64)

    return map_texts(docs.select("text"), "text", "h long, sign long", work, _SLICE)


def _groups(batches, names):
    """Consecutive rows of one value of the first column, as tuples of arrays."""
    held = None
    for batch in _ended(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if held is None:
            continue
        bounds = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
        bounds = [*bounds.tolist(), len(held[0])]
        whole = bounds if batch is None else bounds[:-1]  # the last may go on in the next batch
        for a, b in zip(whole[:-1], whole[1:], strict=True):
            yield tuple(x[a:b] for x in held)
        held = tuple(x[whole[-1] :] for x in held)


def _ended(batches):
    yield from batches
    yield None


def forest(size: np.ndarray, bits: np.ndarray, prints: np.ndarray, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets that may be near, or, with ``sets``, are."""
    left, links = np.arange(len(size)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            # shingles that differ are a ninth of both sizes at most
            most = (size[left] + size[i]) // 9
            near = np.abs(size[left] - size[i]) <= most
            near[near] = np.bitwise_count(bits[left[near]] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most[near]
            if size[i] >= LONG:
                near[near] = (size[left[near]] < LONG) | (np.bitwise_count(prints[left[near]] ^ prints[i]).sum(axis=1, dtype=np.int64) <= RADIUS)
            if sets is not None:
                for k in np.flatnonzero(near).tolist():
                    common = len(np.intersect1d(sets[i], sets[left[k]], assume_unique=True))
                    near[k] = 9 * common >= 4 * (len(sets[i]) + len(sets[left[k]]))
            hit = left[near].tolist()
            links += [(i, j) for j in hit]
            front += hit
            left = left[~near]
    return links


def wide_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parities again, over twice as many bits as the largest set has shingles (``WIDE`` and ``WIDE_BYTES`` at most).

    ``BITS`` tell nothing of sets of over a thousand shingles, which would be
    intersected by pairs wherever SimHash lets them. Bits that tell too little
    cost time and lose no pair.
    """
    room = 1 << (8 * WIDE_BYTES // max(len(sets), 1)).bit_length() - 1
    width = max(BITS, min(1 << (2 * max(map(len, sets), default=1)).bit_length(), WIDE, room))
    out = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for row, h in zip(out, sets, strict=True):
        odd = np.bincount((h >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        row[:] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def _words(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.uint64).reshape(len(cells), -1)


def _candidates(found: DataFrame) -> DataFrame:
    """a, b: links that join all sets that may be near; found: h, sign, size, bits, print."""
    rows = found.repartition("h").sortWithinPartitions("h", "sign")

    def meet(batches):
        links = set()
        for _, sign, size, bits, prints in _groups(batches, ("h", "sign", "size", "bits", "print")):
            if len(sign) > 1:
                links.update((int(sign[i]), int(sign[j])) for i, j in forest(size.astype(np.int64), _words(bits), _words(prints)))
            if len(links) > 200_000:
                yield _links(links)
                links = set()
        if links:
            yield _links(links)
        release()

    return rows.mapInArrow(meet, "a long, b long").distinct()


def _apart(found: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of the shingles whose sets are not all of one component already; found: h, sign; joined: node, component."""
    named = found.join(joined.select(F.col("node").alias("sign"), "component"), "sign", "left").select("h", F.coalesce("component", "sign").alias("part"))
    return found.join(named.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("h"), "h", "left_semi")


def _links(links) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiled(groups: DataFrame) -> DataFrame:
    """sign, doc_id, text_hash, meet: the tasks (a long each) in which a set is compared; groups: component, sign, size, doc_id, text_hash."""
    large = groups.groupBy("component").agg(F.ceil(F.sum("size") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    own = F.pmod(F.xxhash64("sign", F.lit(7)), F.col("tiles")).cast("int")
    # a tile meets every other, and so itself as well
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != own), lambda x: F.xxhash64(F.col("component"), F.least(x, own), F.greatest(x, own)))
    return groups.join(large, "component", "left").select("sign", "doc_id", "text_hash", F.when(F.col("tiles").isNull(), F.array(F.xxhash64("component"))).otherwise(others).alias("meet"))


def _checked(tiled: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: signs of sets with a similarity of 0.8; tiled: sign, doc_id, text_hash, meet; docs: doc_id, text, text_hash."""
    held = docs.join(tiled, ["doc_id", "text_hash"]).select("sign", "meet", "text").dropDuplicates(["sign"])

    def gather(batch):
        sets = Shingles(texts(batch))
        prints = [x.tobytes() for x in sets.prints()]
        return batch.column("sign"), batch.column("meet"), pa.array(prints, pa.binary()), pa.array(sets.cells(), pa.binary())

    sets = map_texts(held, "text", "sign long, meet array<long>, print binary, shingles binary", gather, _SLICE)
    rows = sets.withColumn("meet", F.explode("meet")).repartition("meet").sortWithinPartitions("meet", "sign")

    def compare(batches):
        for _, sign, prints, shingles in _groups(batches, ("meet", "sign", "print", "shingles")):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in shingles]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            if links := forest(size, wide_bitmaps(sets), _words(prints), sets):
                yield _links([(int(sign[i]), int(sign[j])) for i, j in links])
        release()

    return rows.mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id, first: one row for each row of ``docs`` with an id.

    component_id is the smallest id of the component; ``first`` marks the rows
    of that id and, if it has several texts there, of the one that hashes lowest.
    """
    docs = spread(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null"))

    def sign(batch):
        sets = Shingles(texts(batch))
        bits, prints = ([x.tobytes() for x in y] for y in (sets.bitmaps(), sets.prints()))
        return batch.column("doc_id"), batch.column("text_hash"), sets.sign.view(np.int64), sets.size.astype(np.int32), pa.array(bits, pa.binary()), pa.array(prints, pa.binary())

    with Stash(docs.sparkSession) as stash:
        marks = stash.put(map_texts(docs, "text", "doc_id long, text_hash long, sign long, size int, bits binary, print binary", sign, _SLICE))
        nodes = stash.put(marks.groupBy("sign").agg(F.max("size").alias("size"), F.min(F.struct("doc_id", "text_hash")).alias("least")))
        sets = stash.put(marks.select("sign", "size", "bits", "print").distinct())
        agreed = stash.put(block_links(sets, PRINT // 8, RADIUS, stash))
        often = _prefixes(docs, np.zeros(0, np.uint64)).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= HOT)
        last = np.sort(often.orderBy(F.desc("c"), "h").limit(LAST).select("h").toArrow().column("h").to_numpy().view(np.uint64))
        every = stash.put(_prefixes(docs, last))
        # counting alone first: nearly all prefix shingles stand in one set only and end here
        shared = stash.put(every.groupBy("h").agg(F.min("sign").alias("low"), F.max("sign").alias("high")).where("low <> high").select("h"))
        found = stash.put(every.join(shared, "h", "left_semi").distinct())
        stash.forget(every)
        # stored: Spark would take this join's exchange by h for that of _candidates, and then part the rows of one h
        apart = stash.put(_apart(found, components(agreed)))
        stash.forget(found)
        rest = stash.put(_candidates(apart.join(sets, "sign")))
        stash.forget(apart)
        stash.forget(sets)
        lowest = components(agreed.unionByName(rest)).select(F.col("node").alias("sign"), "component")
        groups = lowest.unionByName(lowest.select(F.col("component").alias("sign"), "component").distinct())
        tiled = stash.put(_tiled(stash.put(groups.join(nodes, "sign").select("component", "sign", "size", "least.*"))))
        same = stash.put(_checked(tiled, docs))
        near = stash.put(components(same).select(F.col("node").alias("sign"), F.col("component").alias("root")))
        rooted = stash.put(nodes.join(near, "sign", "left").select("sign", F.coalesce("root", "sign").alias("root"), "least"))
        roots = stash.put(rooted.groupBy("root").agg(F.min("least").alias("least")))
        named = stash.put(rooted.select("sign", "root").join(roots, "root").select("sign", "least"))
        out = marks.join(named, "sign").select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("first"))
        return cut(out)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id; all columns.

    Rows with a null id are kept: nothing can be named as what they copy.
    """
    found = near_copies(docs)
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    at = lambda t: (docs["doc_id"] == t["_id"]) & (F.xxhash64(docs["text"]) == t["_hash"])
    gone = named(found.where("not first")).distinct()
    again = cut(named(found.where("first")).groupBy("_id", "_hash").count().where("count > 1").drop("count"), free=False)
    if not again.head(1):
        return docs.join(gone, at(gone), "left_anti")
    # rows that repeat an id and a text: one of each stays
    many = docs.join(again, at(again), "left_semi")
    sealed = many.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    one = sealed.groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row.*")
    gone = gone.unionByName(again)
    return docs.join(gone, at(gone), "left_anti").unionByName(one)
