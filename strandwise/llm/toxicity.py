"""Toxicity by averaged subword embeddings under a linear softmax.

A text is a bag of the byte n-grams of its words, word ends marked, hashed to
``BUCKETS`` rows of an embedding table. Their mean goes through a linear
softmax; table and softmax are trained together in numpy. A misspelling that
was never seen shares most n-grams with the word that was.

The classifier is fitted on a bounded sample: at most ``TRAIN_ROWS`` labelled
rows of each class, those whose id hashes lowest, with their whole texts. All
rows are scored. As the model is linear in the mean, scoring needs one number
for each bucket (4 MB); that is all that is sent to the executors.

Null and empty texts have no n-grams and score what the bias gives. Rows that
repeat are scored alike. Labels that are null are not used. With labels of one
class or none the score is that class's share (0.5 without labels). Empty
tables give no rows. Other columns are ignored; ids, languages and sources are
never features.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_texts, release, spread, table, texts

BITS = 20
BUCKETS = 1 << BITS
SIZES = (3, 4, 5, 6)
DIM = 8
TRAIN_ROWS = 1500
MIN_DOCS = 5
DECAY = 1e-5
EPOCHS = 8
UPDATES = 120
#: N-grams of no weight that every bag holds besides its own, so that a few words decide less.
PRIOR = 100
HOLD_OUT = 5
#: A-Z to a-z; white space and plain punctuation end words, other signs may stand for letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 32 or chr(c) in ".,;:!?()[]{}\"<>/|" else c for c in range(256))

#: A word said over and over counts once.
_RUN = re.compile(rb"( [^ ]+)\1+(?= )")


def grams(docs: list[bytes]):
    """(hashes, mask of n-grams that stay in a word) for each size, over the texts laid end to end; and their bounds."""
    laid = [_RUN.sub(rb"\1", b" " + t.translate(_FOLD) + b" ") for t in docs]
    ends = np.cumsum(np.fromiter(map(len, laid), np.int64, len(laid)))
    data = np.frombuffer(b"".join(laid), dtype=np.uint8)

    def each():
        letter = data != 32
        h = data.astype(np.uint32)
        inner = None
        for n in range(2, max(SIZES) + 1):
            if len(data) < n:
                return
            h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :]
            if n >= 3:
                inner = letter[1 : len(data) - n + 2] if inner is None else inner[:-1] & letter[n - 2 : len(data) - 1]
            if n in SIZES:
                mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BITS), inner

    return each(), ends


def bags(docs: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (of one slice of texts): document, bucket, share of the document's n-grams.

    ``keep``: mask of the buckets that are wanted; the others count in the shares only.
    """
    keys = []
    parts, ends = grams(docs)
    for h, ok in parts:
        at = np.flatnonzero(ok)
        keys.append(np.searchsorted(ends, at, side="right") << BITS | h[at].astype(np.int64))
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    doc, bucket = key >> BITS, key & (BUCKETS - 1)
    part = count / (np.bincount(doc, weights=count, minlength=len(docs))[doc] + PRIOR)
    if keep is not None:
        own = keep[bucket]
        doc, bucket, part = doc[own], bucket[own], part[own]
    return doc.astype(np.int32), bucket.astype(np.int32), part.astype(np.float32)


def parts_of(docs: list[bytes], limit: int = 1 << 20):
    """(number of the first, texts) of slices with about ``limit`` bytes: n-grams take many times a text's memory."""
    first, held = 0, 0
    for i, t in enumerate(docs):
        held += len(t)
        if held > limit:
            yield first, docs[first : i + 1]
            first, held = i + 1, 0
    if first < len(docs):
        yield first, docs[first:]


class Model:
    """weight: one logit for each bucket; bias: the logit of an empty bag."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def score(self, docs: list[bytes]) -> np.ndarray:
        parts, ends = grams(docs)
        total = np.zeros(len(docs))
        count = np.zeros(len(docs))
        starts = np.r_[0, ends[:-1]]
        for h, ok in parts:
            value = np.where(ok, self.weight[h], np.float32(0))
            at = np.minimum(starts, len(ok) - 1)
            own = starts < len(ok)
            total[own] += np.add.reduceat(value, at[own], dtype=np.float64)
            count[own] += np.add.reduceat(ok, at[own], dtype=np.int64)
        return 1 / (1 + np.exp(-(self.bias + total / (count + PRIOR))))


def fit(docs: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly by Adagrad on batches of documents."""
    y = np.asarray(labels, dtype=np.int64)
    share = y.mean() if len(y) else 0.5
    if len(np.unique(y)) < 2:
        p = min(max(share, 0.001), 0.999)
        return Model(np.zeros(BUCKETS), np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    # n-grams of fewer texts (copies counted once) say nothing that carries over; they stay at zero
    seen: dict[bytes, int] = {}
    distinct = np.array([seen.setdefault(t, i) == i for i, t in enumerate(docs)])
    per_class = [np.zeros(BUCKETS, dtype=np.int64) for _ in (0, 1)]
    for at, some in parts_of(docs):
        doc, bucket, _ = bags(some)
        own = distinct[at + doc]
        for c in (0, 1):
            per_class[c] += np.bincount(bucket[own & (y[at + doc] == c)], minlength=BUCKETS)
    often = sum(per_class) >= min(MIN_DOCS, max(1, len(docs) // 20))
    size, buckets, shares = np.zeros(len(docs), dtype=np.int64), [], []
    for at, some in parts_of(docs):
        doc, bucket, part = bags(some, often)
        size[at : at + len(some)] = np.bincount(doc, minlength=len(some))
        buckets.append(bucket)
        shares.append(part)
    first = np.r_[0, np.cumsum(size)]
    bucket = np.concatenate(buckets)
    del buckets
    part = np.concatenate(shares)
    del shares
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    # the first dimension starts from each n-gram's document log-odds, squared to favour the telling ones
    odds = np.log((per_class[1] + 1) / (y.sum() + 2)) - np.log((per_class[0] + 1) / (len(y) - y.sum() + 2))
    sure = np.sqrt(sum(per_class) / (sum(per_class) + 10.0))
    table[:, 0] = 0.1 * odds * np.abs(odds) * sure
    soft[0] = -0.5, 0.5
    bias = np.zeros(2)
    g_table, g_soft, g_bias = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    steps = max(1, len(docs) // 64)
    epochs = max(EPOCHS, -(-UPDATES // steps))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(docs)), steps):
            cells = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            row = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            own, inverse = np.unique(bucket[cells], return_inverse=True)
            bag = np.zeros((len(rows), len(own)), dtype=np.float32)
            bag[row, inverse] = part[cells]
            bag *= SCALE
            mean = bag @ table[own]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            err = (p / len(rows)).astype(np.float32)
            d_soft, d_bias, d_table = mean.T @ err, err.sum(axis=0), bag.T @ (err @ soft.T) + DECAY * table[own]
            g_soft += d_soft**2
            g_bias += d_bias**2
            g_table[own] += (d_table**2).mean(axis=1)
            soft -= (rate * d_soft / np.sqrt(g_soft)).astype(np.float32)
            bias -= rate * d_bias / np.sqrt(g_bias)
            table[own] -= (rate * d_table / np.sqrt(g_table[own])[:, None]).astype(np.float32)
    out = np.where(often, table @ (soft[:, 1] - soft[:, 0]) * SCALE, 0)
    return Model(out, bias[1] - bias[0])


#: Means are small where few words of a long text matter; the softmax sees them times this.
SCALE = 30.0


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, hold_out: int = HOLD_OUT) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts of each class, never of the held-out ids."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(crc_of_id() % hold_out != 0)
    chosen = {r["doc_id"]: r["toxic"] for c in (0, 1) for r in labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    if not chosen:
        return [], np.zeros(0, dtype=np.int64)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(k,) for k in sorted(chosen)], "doc_id long"))  # 2 * rows ids at most
    got = sorted((r["doc_id"], bytes(r["text"] or b"")) for r in docs.join(ids, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text")).toLocalIterator())
    return [t for _, t in got], np.array([chosen[k] for k, _ in got], dtype=np.int64)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for every row."""
    docs = docs.select("doc_id", "text")
    model = fit(*sample(docs, labels))

    def work(batch):
        return batch.column("doc_id"), pa.array(model.score(texts(batch)))

    return map_texts(spread(docs), "text", "doc_id long, score double", work, 1 << 20)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; all columns."""
    model = fit(*sample(docs.select("doc_id", "text"), labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out, part, held = [], [], 0
        for t in text:
            part.append((t or "").encode())
            held += len(part[-1])
            if held > 1 << 20:
                out.append(model.score(part))
                part, held = [], 0
        if part:
            out.append(model.score(part))
        part = []
        release()
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score("text") < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_of_id() % HOLD_OUT == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
