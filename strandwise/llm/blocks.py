"""Wide SimHash fingerprints: candidates by blocks, compared bit-sliced.

A fingerprint is cut into blocks of whole bytes; those that agree in a block
meet. Blocks are as wide as the number of fingerprints asks for, so that
unrelated ones seldom meet however many there are. What meets is compared as
``simhash`` does it: fingerprints stand as vertical bit planes, 64 to a word,
and a tree of carry-save adders counts the planes that differ. Rows of small
groups are compared with the rows d places below, for all groups at once; in a
large group one row is compared with all that no link has reached, and a row
that was reached is not compared with its like again.

At a wide radius two near fingerprints may agree in no block (README has
figures), so blocks alone do not find all; a caller that needs all of them
looks for the rest by other means.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, release
from .simhash import FULL, _down, _unpack, planes

#: Bits of a block beyond those that number the fingerprints.
SPARE = 8
#: Groups of more rows are compared row by row with what is left of them.
FEW = 8
#: Rows of one block that meet in a task; more are dealt to tasks of about so many, and pairs across these are left to the caller.
MOST = 1 << 17
#: Rows that a task compares at once.
_ROWS = 1 << 15


def _any(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ones(len(a), bool)


def wide_planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints of several words (a row each)."""
    return np.concatenate([planes(np.ascontiguousarray(word)) for word in prints.T])


def over(differ: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the lanes in which more than ``radius`` of the planes are set."""
    counter, now = [], differ
    while len(now):
        carries = []
        while len(now) > 1:
            m = len(now) // 3
            if m:
                a, b, c = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                half = a ^ b
                carries.append(a & b | half & c)
                now = np.concatenate([half ^ c, now[3 * m :]])
            else:
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
        counter.append(now[0])
        now = np.concatenate(carries) if carries else now[:0]
    more, same = np.zeros(differ.shape[1], np.uint64), np.full(differ.shape[1], FULL)
    for k in range(max(len(counter), radius.bit_length()))[::-1]:
        c = counter[k] if k < len(counter) else np.zeros_like(more)
        if radius >> k & 1:
            same &= c
        else:
            more |= same & c
            same &= ~c
    return more


def links(key: np.ndarray, prints: np.ndarray, radius: int, fits: Callable = _any) -> tuple[np.ndarray, np.ndarray]:
    """Rows, by pairs, that join all rows of one key (rows are sorted by it) that are within ``radius`` of one another.

    ``fits`` marks the pairs, of two arrays of rows, that may be linked.
    """
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, n])
    group, held = np.repeat(np.arange(len(first)), count), np.repeat(count, count)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    rows = None
    for d in range(1, FEW):
        now = np.flatnonzero((held > d) & (held <= FEW))
        if not len(now):
            break
        if rows is None or len(now) < len(rows):
            rows, sliced = now, wide_planes(prints[now])
        near = _unpack(~over(sliced ^ _down(sliced, d), radius), len(rows))[:-d]
        i = np.flatnonzero(near & (group[rows[:-d]] == group[rows[d:]]))
        fit = fits(rows[i], rows[i + d])
        found.append((rows[i[fit]], rows[i[fit] + d]))
    for g in np.flatnonzero(count > FEW).tolist():
        a, b = _tree(prints[first[g] : first[g] + count[g]], radius, lambda i, j, at=first[g]: fits(i + at, j + at))
        found.append((a + first[g], b + first[g]))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _tree(prints: np.ndarray, radius: int, fits: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within ``radius`` that fit."""
    n, sliced, bits = len(prints), wide_planes(prints), prints.view(np.uint8)
    left, front, found = np.ones(n, bool), [], []

    def near(i, among):
        own = np.unpackbits(bits[i].reshape(-1, 8), axis=1, bitorder="little").ravel()
        hit = np.flatnonzero(_unpack(~over(sliced ^ np.where(own, FULL, np.uint64(0))[:, None], radius), n) & among)
        return hit[fits(np.full(len(hit), i), hit)]

    while left.any():
        if not front:
            front = [int(np.argmax(left))]
            left[front[0]] = False
            continue
        if len(front) <= left.sum():
            i = front.pop()
            hit = near(i, left)
            found += [(i, j) for j in hit.tolist()]
            left[hit] = False
            front += hit.tolist()
            continue
        # fewer are left than reached: ask these, until one of them is reached no more
        reached = np.zeros(n, bool)
        reached[front] = True
        front = []
        for j in np.flatnonzero(left).tolist():
            if len(hit := near(j, reached)):
                found.append((int(hit[0]), j))
                left[j] = False
                front.append(j)
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def block_links(sets: DataFrame, width: int, radius: int, stash: Stash) -> DataFrame:
    """a, b: links between fingerprints that agree in a block and are within ``radius``.

    sets: sign (long, unique), size, bits (parities), print (binary of ``width``
    bytes). As shingles that differ are a ninth of both sizes at most, so must be
    the difference of the sizes and the parities that differ.
    """
    wide = min(width, -(-(sets.count().bit_length() + SPARE) // 8))
    keys = F.array(*(F.xxhash64(F.substring("print", 1 + k * wide, wide), F.lit(k)) for k in range(width // wide)))
    rows = sets.select("sign", F.explode(keys).alias("key"))
    # counting alone first: nearly all blocks are those of one fingerprint
    held = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / MOST).cast("int").alias("tiles"))
    tile = F.when(F.col("tiles") > 1, F.xxhash64("key", F.pmod(F.xxhash64("sign", F.lit(7)), F.col("tiles")))).otherwise(F.col("key"))
    met = stash.put(rows.join(held, "key").select("sign", tile.alias("key")))
    ordered = met.join(sets, "sign").repartition("key").sortWithinPartitions("key", "sign")

    def compare(batches):
        for key, sign, size, bits, prints in _runs(batches):

            def fits(i, j, size=size, bits=bits):
                most = (size[i] + size[j]) // 9
                return (np.abs(size[i] - size[j]) <= most) & (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most)

            i, j = links(key, prints, radius, fits)
            if len(i):
                pairs = np.unique(np.sort(np.stack([sign[i], sign[j]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])
        release()

    return ordered.select("key", "sign", "size", "bits", "print").mapInArrow(compare, "a long, b long").distinct()


def _runs(batches):
    """Whole groups of one key, as many as make ``_ROWS`` rows: key, sign, size, parities, fingerprints."""
    parts, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        wide = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("bits", "print"))
        parts.append((*(batch.column(c).to_numpy() for c in ("key", "sign")), batch.column("size").to_numpy().astype(np.int64), *wide))
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        # the last key may go on in the next batch
        end = int(np.searchsorted(whole[0], whole[0][-1], side="left"))
        parts = [tuple(x[end:].copy() for x in whole)]
        # a group that goes on is not joined with every batch again
        rows = 0 if not end else len(parts[0][0])
        if end:
            yield tuple(x[:end] for x in whole)
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
