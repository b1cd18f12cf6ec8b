"""SimHash near-duplicates, compared bit-sliced.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. The
64 bits are six blocks; with four differing bits two blocks at least agree, so
every link is found under one of fifteen keys of two blocks (exact, no cap).
Equal fingerprints are one node before anything is compared.

Rows sorted by key are compared with the rows that stand d places below, for
all rows at once: the fingerprints are kept as vertical bit planes (64 rows to
a word), the differing planes are added up in a bitwise carry-save counter, and
a block of rows is abandoned once every lane is over the radius. A key held by
more rows than ``TILE`` is split into tiles, and pairs of tiles are separate
groups. Inside a group links are reduced to a spanning forest before they leave
the task, which keeps the components and never emits all pairs.

Null and empty texts have fingerprint zero. Repeated rows are rows of the same
fingerprint. A null id takes no part in choosing component ids. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, spread, table, texts
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 8192
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
ONE = np.uint64(1)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority vote over the hashes of ``width``-word shingles, repeats included."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    k = max(1, len(words) - width + 1)
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, k, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > k).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit)."""

    def work(batch):
        fps = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
        return batch.column("doc_id"), fps

    return map_texts(docs.select("doc_id", "text"), "text", "doc_id long, fp long", work)


# ------------------------------------------------------------- bit slicing


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 values: row b holds bit b of all of them, 64 to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def _down(words: np.ndarray, d: int) -> np.ndarray:
    """Lane i takes lane i + d."""
    q, r = divmod(d, 64)
    out = np.zeros_like(words)
    out[..., : words.shape[-1] - q] = words[..., q:]
    if r:
        low = out >> np.uint64(r)
        low[..., :-1] |= out[..., 1:] << np.uint64(64 - r)
        out = low
    return out


def within(one: np.ndarray, other: np.ndarray, radius: int = RADIUS, step: int = 8) -> np.ndarray:
    """Mask of lanes whose distance is at most ``radius``; both are bit planes.

    A carry-save counter of three bits and an overflow mark counts differing
    bits for 64 lanes a word. Words in which every lane is over are abandoned
    after each ``step`` planes.
    """
    words = one.shape[1]
    alive = np.arange(words)
    result = np.zeros(words, dtype=np.uint64)
    c0, c1, c2, over = (np.zeros(words, dtype=np.uint64) for _ in range(4))
    limit = radius + 1
    for b in range(0, 64, step):
        for p in range(b, b + step):
            carry = one[p, alive] ^ other[p, alive]
            c0, carry = c0 ^ carry, c0 & carry
            c1, carry = c1 ^ carry, c1 & carry
            c2, carry = c2 ^ carry, c2 & carry
            over |= carry
        # lanes with a count of limit or more: compare the counter with a constant, bit by bit
        more, same = np.zeros_like(over), np.full_like(over, FULL)
        for k, c in ((2, c2), (1, c1), (0, c0)):
            if limit >> k & 1:
                same &= c
            else:
                more |= same & c
                same &= ~c
        over |= more | same
        keep = over != FULL
        if not keep.any():
            return result
        if keep.sum() < 0.75 * len(keep):
            alive, c0, c1, c2, over = (x[keep] for x in (alive, c0, c1, c2, over))
    result[alive] = ~over
    return result


def forest(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest for rows sorted by key: all rows d apart at once."""
    n = len(key)
    label = np.arange(n)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + size, size)
    rows = np.flatnonzero(np.repeat(size, size) > 1)
    d = 1
    sliced = None
    while len(rows):
        if sliced is None:
            held = rows
            sliced = planes(fp[held].view(np.uint64))
            where = ends[held]
        if d >= len(held):
            break
        hit = _unpack(within(sliced, _down(sliced, d), radius), len(held))
        hit[len(held) - d :] = False
        i = np.flatnonzero(hit)
        i = i[where[i] == where[i + d]]  # the same run
        a, b = held[i], held[i + d]
        differ = label[a] != label[b]
        for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                label[max(p, q)] = min(p, q)
                links.append((x, y))
        while differ.any() and not np.array_equal(label, up := label[label]):
            label = up
        d += 1
        longest = size[size >= d + 1]
        if not len(longest):
            break
        if longest.sum() < 0.7 * len(held):
            rows, sliced = np.flatnonzero(np.repeat(size, size) > d), None
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array(links).T
    return node[a], node[b]


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that keep the components of fingerprints within ``radius``.

    nodes: node (long, unique), fp (unique).
    """
    mask = [((1 << w) - 1) << s for s, w in BLOCKS]
    signed = [m - (1 << 64) if m >> 63 else m for m in mask]
    keys = []
    for t, (i, j) in enumerate((i, j) for i in range(len(BLOCKS)) for j in range(i + 1, len(BLOCKS))):
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed[i] | signed[j])), F.lit(t)))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    hot = cut(rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles")))
    if hot.head(1):
        # the pair (x, y) of tiles meets in one group; a row goes to the groups that its tile is in
        rows = rows.join(hot, "key", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.xxhash64(F.col("key"), F.least(x, own), F.greatest(x, own)))
        rows = rows.select("node", "fp", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(others)).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key", "node")

    def compare(batches):
        held = None
        for batch in [*_regrouped(batches), None]:
            if batch is not None:
                held = batch if held is None else tuple(np.concatenate(x) for x in zip(held, batch, strict=True))
                if len(held[0]) < 200_000:
                    continue
                # the last key may go on in the next batch
                end = int(np.searchsorted(held[0], held[0][-1], side="left")) if held[0][0] != held[0][-1] else 0
            else:
                end = len(held[0]) if held is not None else 0
            if end:
                a, b = forest(*(x[:end] for x in held), radius)
                held = tuple(x[end:] for x in held)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select("key", "fp", "node").mapInArrow(compare, "a long, b long")


def _regrouped(batches):
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).to_numpy() for c in ("key", "fp", "node"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``."""
    prints = cut(fingerprints(spread(docs)))
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = cut(nodes)
    found = components(near_links(nodes, radius)).withColumnRenamed("node", "_node")
    named = nodes.join(found, nodes["node"] == found["_node"], "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
