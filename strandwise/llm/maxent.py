"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class, given the words before, times
that of the token in its class. The class softmax is log-linear: weights of the
word before, of the word two before (a skip), and of the pair of their classes
(an n-gram), each a hashed row of ``CLASSES`` weights. The factor in the class
is the base model's smoothed count, with an unseen word in every class.

Counts run over the whole training text: words are hashed to 64 bits and summed
with map-side combine. Classes are the end, the commonest words and common word
beginnings. Training rows are dealt by a hash of id and text to shards of about
``SHARD_TOKENS`` tokens, ``SHARDS`` of them at most, and sorted there. Every
shard runs gradient updates over all its tokens in batches (one pass, Adagrad);
their weights are averaged, each row by how often it was met (parameter
mixing), in a streaming sum over sorted blocks. So neither files nor cores nor
partitions, of the input or of a shuffle, change a score, and the weights that
are shuffled follow the shards alone.

For scoring, counts of the ``HEAD`` commonest words go to the executors (a
fixed size); tokens of rarer words are joined with the counts by hash. Those
have no hot key, as hot words are in the head. Scores are sums, so texts are
not shuffled. The class part needs no join, as classes follow from the bytes
of a word.

Null and empty texts are the end token alone. Without training tokens (an empty
table, or only held-out rows) the base probability is 1 for the only, unknown
token type. Repeated rows are scored each. Null ids count as the text ''.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, spread, table, texts
from .substring import Rolling

CLASSES = 64
WORD_CLASSES = 24
PREFIX_CLASSES = CLASSES - WORD_CLASSES - 8
HEAD = 1 << 18
SLOTS = 1 << 21
NEAR = 4096
RATE = 0.15
BATCH = 4096
#: Training tokens of a shard; beyond ``SHARDS`` shards they hold more, so that the weights that are summed stay bounded.
SHARD_TOKENS = 4 << 20
SHARDS = 4096
HOLD_OUT = 10
ALPHA = 0.1
_BASE = 0xA24BAED4963EE407
_SLICE = 2 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
END = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """Tokens of a slice of documents, an end after each: hash, first two bytes, document."""

    def __init__(self, docs: list[bytes]):
        self.n_docs = len(docs)
        # a text ends with a space, the end mark and a space; the mark is byte 0 after a byte that UTF-8 never has
        laid = [t.translate(_FOLD) + b" \xff\x00 " for t in docs]
        data = np.frombuffer(b"".join(laid), dtype=np.uint8)
        inside = data != 32
        begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        stop = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
        self.hash = Rolling(_BYTES[data], _BASE).span(begin, stop)
        second = np.where(stop - begin > 1, data[np.minimum(begin + 1, len(data) - 1)], 0)
        self.prefix = data[begin].astype(np.int32) << 8 | second
        end = self.prefix == 0xFF00
        self.hash[end] = END
        self.prefix[end] = 0
        self.doc = np.cumsum(end) - end
        self.end = end


def _held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % HOLD_OUT == 0 for i in ids])


def _is_held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def counts(docs: DataFrame) -> DataFrame:
    """h, prefix, c over the tokens of training rows."""

    def work(batch):
        train = ~_held_out(batch.column("doc_id").to_pylist())
        own = [t for t, use in zip(texts(batch), train, strict=True) if use]
        if not own:
            return None
        tokens = Tokens(own)
        h, first, c = np.unique(tokens.hash, return_index=True, return_counts=True)
        return h.view(np.int64), tokens.prefix[first].astype(np.int32), c

    parts = map_texts(docs, "text", "h long, prefix int, c long", work, 8 << 20)
    return parts.groupBy("h").agg(F.first("prefix").alias("prefix"), F.sum("c").alias("c"))


class Lexicon:
    """What every task needs to know of the vocabulary; of fixed size."""

    def __init__(self, head: pa.Table, n: int, v: int, by_prefix: list):
        self.n, self.v = n, v
        self.total = n + ALPHA * (v + 1)
        h, prefixes, c = (head.column(x).to_numpy() for x in ("h", "prefix", "c"))
        order = np.lexsort((h, -c))
        h, prefixes, c = h[order].view(np.uint64), prefixes[order], c[order]
        # of two words in a slot the commoner stays, the other is joined
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        rank = np.sort(np.unique(at, return_index=True)[1])
        hashes, c = h[rank], c[rank]
        self.slot = np.full(SLOTS, -1, dtype=np.int32)
        self.slot[at[rank]] = np.arange(len(rank))
        self.hash = hashes if len(rank) else np.zeros(1, dtype=np.uint64)
        self.count = c if len(rank) else np.zeros(1, dtype=np.int64)
        self.near = np.where(rank < NEAR, rank + CLASSES, -1).astype(np.int32) if len(rank) else np.full(1, -1, dtype=np.int32)
        # classes: 0 the end, then common words, common beginnings, and the others by hash of the beginning
        self.word_class = np.full(len(self.hash), -1, dtype=np.int32)
        self.prefix_class = WORD_CLASSES + PREFIX_CLASSES + np.arange(1 << 16, dtype=np.int32) * 40503 % (1 << 16) % (CLASSES - WORD_CLASSES - PREFIX_CLASSES)
        mass, kinds = np.zeros(1 << 16), np.zeros(1 << 16)
        for prefix, tokens, words in by_prefix:
            mass[prefix], kinds[prefix] = tokens, words
        self.mass, self.kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        k = 1
        common = np.flatnonzero(hashes != END)[: WORD_CLASSES - 1]
        for i in [*np.flatnonzero(hashes == END), *common]:
            own = 0 if hashes[i] == END else k
            k += hashes[i] != END
            self.word_class[i] = own
            self.mass[own], self.kinds[own] = self.count[i], 1
            prefix = prefixes[rank[i]]
            mass[prefix] -= self.count[i]
            kinds[prefix] -= 1
        for j, p in enumerate(np.argsort(-mass, kind="stable")[:PREFIX_CLASSES]):
            self.prefix_class[p] = WORD_CLASSES + j
        self.mass += np.bincount(self.prefix_class, weights=mass, minlength=CLASSES)
        self.kinds += np.bincount(self.prefix_class, weights=kinds, minlength=CLASSES)
        self.within = np.log10(self.mass + ALPHA * (self.kinds + 1))
        self.log_base = np.log10((self.count + ALPHA) / self.total) if len(rank) else np.zeros(1)
        self.known = len(rank) > 0

    def find(self, tokens: Tokens) -> np.ndarray:
        """Place in the head, or -1."""
        at = self.slot[(tokens.hash & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.hash[at] == tokens.hash), at, -1)

    def features(self, tokens: Tokens, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and three feature rows for each token: word before, skip, pair of classes."""
        own = np.where(place >= 0, self.word_class[place], -1)
        k = np.where(own >= 0, own, self.prefix_class[tokens.prefix])
        k[tokens.end] = 0
        word = np.where((place >= 0) & (self.near[place] >= 0), self.near[place], k)
        # before the first word stands the end of the text before
        one, two = np.r_[0, word[:-1]], np.r_[0, 0, word][:len(word)]
        k1, k2 = np.r_[0, k[:-1]], np.r_[0, 0, k][:len(k)]
        start = np.r_[True, tokens.end[:-1]]
        second = np.r_[False, start[:-1]]
        one[start], k1[start] = 0, 0
        two[start | second], k2[start | second] = 0, 0
        return k, np.stack([one, NEAR + CLASSES + two, 2 * (NEAR + CLASSES) + k1 * CLASSES + k2])


ROWS = 2 * (NEAR + CLASSES) + CLASSES * CLASSES


class Weights:
    def __init__(self, lexicon: Lexicon, w: np.ndarray | None = None):
        self.w = np.zeros((ROWS, CLASSES), dtype=np.float32) if w is None else w
        self.bias = np.log((lexicon.mass + ALPHA) / (lexicon.mass + ALPHA).sum()).astype(np.float32)
        self.squares = np.full(ROWS, 1e-2, dtype=np.float32)
        self.met = np.zeros(ROWS, dtype=np.int64)

    def chances(self, rows: np.ndarray) -> np.ndarray:
        z = self.w[rows[0]]
        z += self.w[rows[1]]
        z += self.w[rows[2]]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def update(self, rows: np.ndarray, k: np.ndarray) -> None:
        """One step up the gradient of the log-likelihood: what was seen less what is expected."""
        p = self.chances(rows)
        np.negative(p, out=p)
        p[np.arange(len(k)), k] += 1
        for r in rows:
            order = np.argsort(r, kind="stable")
            s = r[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            own = s[first]
            g = np.add.reduceat(p[order], first, axis=0)
            self.squares[own] += np.einsum("ij,ij->i", g, g) / CLASSES
            self.w[own] += RATE * g / np.sqrt(self.squares[own])[:, None]
            self.met[own] += np.diff(np.r_[first, len(s)])


BLOCK = 128


def train(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Average of the shards' weights, each row by its number of tokens."""
    shards = min(SHARDS, max(1, -(-lexicon.n // SHARD_TOKENS)))
    key = F.xxhash64("doc_id", "text")
    # the shard is the row's own and not the partition it comes to: partitions may be more or fewer, and hold no shard or some
    shard = F.pmod(F.hash(key), F.lit(shards))
    dealt = docs.select(shard.alias("_shard"), key.alias("_key"), "doc_id", "text").where(~_is_held_out()).repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_key", "doc_id")

    def local(batches):
        from .common import slices

        shard, weights = None, None
        for batch in batches:
            own = batch.column("_shard").to_numpy()
            bounds = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if len(own) else []
            for a, b in zip(bounds, [*bounds[1:], len(own)], strict=True):
                if own[a] != shard:
                    if weights is not None and weights.met.any():
                        yield _blocks(shard, weights)
                    shard, weights = int(own[a]), Weights(lexicon)
                for part in slices(batch.slice(a, b - a), "text", _SLICE):
                    tokens = Tokens(texts(part))
                    k, rows = lexicon.features(tokens, lexicon.find(tokens))
                    for at in range(0, len(k), BATCH):
                        weights.update(rows[:, at : at + BATCH], k[at : at + BATCH])
        if weights is not None and weights.met.any():
            yield _blocks(shard, weights)

    def _blocks(shard, weights):
        blocks = [b for b in range(-(-ROWS // BLOCK)) if weights.met[b * BLOCK : (b + 1) * BLOCK].any()]
        cells = [slice(b * BLOCK, (b + 1) * BLOCK) for b in blocks]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array([weights.met[c].astype("<i8").tobytes() for c in cells], pa.binary()), pa.array([(weights.w[c] * weights.met[c][:, None]).astype("<f4").tobytes() for c in cells], pa.binary())], names=["block", "shard", "met", "w"])

    def total(batches):
        now, met, w = None, None, None
        for batch in batches:
            for b, m, x in zip(*(batch.column(i).to_pylist() for i in ("block", "met", "w")), strict=True):
                m, x = np.frombuffer(m, "<i8"), np.frombuffer(x, "<f4").astype(np.float64)
                if b != now:
                    if now is not None:
                        yield _row(now, met, w)
                    now, met, w = b, m.copy(), x.copy()
                else:
                    met += m
                    w += x
        if now is not None:
            yield _row(now, met, w)

    def _row(b, met, w):
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([met.astype("<i8").tobytes()], pa.binary()), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["block", "met", "w"])

    parts = dealt.mapInArrow(local, "block int, shard int, met binary, w binary")
    # in the order of shards, as sums of floats hang on theirs
    sums = parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(total, "block int, met binary, w binary")
    out = np.zeros((ROWS, CLASSES), dtype=np.float32)
    for r in sums.collect():  # the model itself: ROWS rows
        at = r["block"] * BLOCK
        met = np.frombuffer(r["met"], "<i8")
        out[at : at + len(met)] = np.frombuffer(r["w"], "<f4").reshape(len(met), CLASSES) / np.maximum(met, 1)[:, None]
    return out


def commonest(vocabulary: DataFrame, most: int = HEAD) -> pa.Table:
    """h, prefix, c of the commonest words, ``most`` at most, and the end.

    A histogram over ranges of counts, and inside the last of them over ranges
    of hashes, tells where to stop; then only the words that are wanted come.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    part = F.shiftrightunsigned("h", 54).cast("int")
    cut_at, room = 1 << 30, most
    sizes = vocabulary.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 512 rows at most
    over = None
    for r in sizes:
        if r["count"] > room:
            over = r["level"]
            break
        cut_at, room = r["level"], room - r["count"]
    wanted = (level >= cut_at) | (F.col("h") == int(END.view(np.int64)))
    if over is not None:
        upto = -1
        for r in vocabulary.where(level == over).groupBy(part.alias("part")).count().orderBy("part").collect():  # 1,024 rows at most
            if r["count"] > room:
                break
            upto, room = r["part"], room - r["count"]
        wanted |= (level == over) & (part <= upto)
    return vocabulary.where(wanted).select("h", "prefix", "c").toArrow()


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    docs = spread(docs.select("doc_id", "text"))
    vocabulary = cut(counts(docs))
    n, v = vocabulary.agg(F.sum("c"), F.count("*")).first()
    head = commonest(vocabulary)
    by_prefix = [tuple(r) for r in vocabulary.groupBy("prefix").agg(F.sum("c"), F.count("*")).collect()]  # 65,536 rows at most
    lexicon = Lexicon(head, n or 0, v or 0, by_prefix)
    del head
    weights = Weights(lexicon, train(docs, lexicon)) if n else None
    total = lexicon.total

    def work(part, number):
        tokens = Tokens(texts(part))
        size = tokens.n_docs
        place = lexicon.find(tokens)
        gain = np.zeros(size)
        if weights is not None:
            k, rows = lexicon.features(tokens, place)
            for at in range(0, len(k), BATCH):
                own = k[at : at + BATCH]
                p = weights.chances(rows[:, at : at + BATCH])[np.arange(len(own)), own]
                gain += np.bincount(tokens.doc[at : at + BATCH], weights=np.log10(np.maximum(p, 1e-30)) + math.log10(total) - lexicon.within[own], minlength=size)
        common = (place >= 0) & lexicon.known
        base = np.bincount(tokens.doc[common], weights=lexicon.log_base[place[common]], minlength=size)
        rare = np.flatnonzero(~common)
        uid = number + np.arange(size)
        ids = part.column("doc_id")
        # one row for each document, dealt evenly, and one for each token outside the head
        null = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(len(rare), kind)])
        return [
            pa.array(np.r_[uid, uid[tokens.doc[rare]]]),
            pa.array(np.r_[uid * 0x5DEECE66D, tokens.hash[rare].view(np.int64)]),
            pa.concat_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.nulls(len(rare), pa.int64())]),
            null(np.bincount(tokens.doc, minlength=size), pa.int64()),
            null(np.bincount(tokens.doc[common], minlength=size), pa.int64()),
            null(base, pa.float64()),
            null(gain, pa.float64()),
        ]

    names = ["uid", "h", "doc_id", "n_tokens", "n_known", "base", "gain"]

    def run(batches):
        from pyspark import TaskContext

        from .common import slices

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays(work(part, number), names=names)
                number += part.num_rows

    rows = docs.mapInArrow(run, "uid long, h long, doc_id long, n_tokens long, n_known long, base double, gain double")
    tail = vocabulary.select(F.col("h").alias("_h"), F.col("c"))
    joined = rows.join(tail, (rows["h"] == tail["_h"]) & rows["n_tokens"].isNull(), "left")
    value = F.when(F.col("n_tokens").isNull(), F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / F.lit(total))).otherwise(F.col("base"))
    known = F.when(F.col("n_tokens").isNull(), F.when(F.col("c").isNotNull(), 1).otherwise(0)).otherwise(F.col("n_known"))
    out = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(value).alias("base_score"), F.sum("gain").alias("gain"))
    return out.select("doc_id", _is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(lexicon.n)).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
