"""Substring dedup by compaction of the token de Bruijn graph.

An edge is a window of ``WINDOW`` consecutive words. A word goes if some window
that covers it also starts earlier: in a document of smaller id, or earlier in
the same document.

Shuffling every edge would move many times the input. Edges are compacted
first: windows in a row whose smallest ``GRAM``-word hash is the same one form
a path (nonbranching inside its document), about one for eight words. Equal
windows have equal smallest grams, so a window can only repeat under a gram
that is the smallest of two places at least. A join with the grams that are
keeps those paths and drops the rest, which is nearly all unique text.

Paths of equal gram and equal content are one compacted path; all but its
earliest source are covered whole. Where one gram has paths of different
content - a branching, at the ends of a repeat - or repeats inside a path, the
earliest sources are expanded into their windows again at their source
coordinates, and windows are compared one by one by 128-bit hashes. Copies are
never expanded, so a passage shared by a third of all documents costs one
expansion and one short row for each of them. All counts and minima combine
before they are shuffled.

Null texts have no words. Rows with a null id are left as they are and are no
source. A document is an id with a text: rows that repeat both are one document
and are treated alike; rows of one id and several texts are documents of their
own, ties between them going by their texts' hashes. Documents under a window's length
lose nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, cut, map_texts, set_apart, spread, table, texts

WINDOW = 20
GRAM = 5
SPAN = WINDOW - GRAM + 1
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SLICE = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any word span of a slice from prefix sums, wrapping at 64 bits."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        self.back = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(hashes * powers[:-1], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


class Words:
    """The words of a slice of documents, laid end to end."""

    def __init__(self, docs: list[bytes]):
        from xxhash import xxh3_64_intdigest as digest

        each = [t.split() for t in docs]
        self.count = np.fromiter(map(len, each), np.int64, len(each))
        total = int(self.count.sum())
        self.hashes = np.fromiter((digest(w) for ws in each for w in ws), np.uint64, total)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(docs)), self.count)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _text (its text's hash), text: the key of a document, as ids may repeat."""
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")


#: A place: smaller ones are earlier.
_PLACE = ("doc_id", "start", "_text")


def paths(docs: DataFrame) -> DataFrame:
    """Compacted paths: gram, body (content hash), doc_id, _text, start, n (windows), twice.

    ``twice``: the gram occurs again inside, so windows of the path may be equal.
    """

    def work(batch):
        words = Words(texts(batch))
        n = len(words.hashes) - WINDOW + 1
        if n < 1:
            return None
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_text"))
        rolling = Rolling(words.hashes, _BASE[0])
        at = np.arange(len(words.hashes) - GRAM + 1)
        grams = rolling.span(at, at + GRAM)
        least, width = grams, 1
        while width < SPAN:  # doubling: the smallest of SPAN grams in a row
            step = min(width, SPAN - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        starts = np.arange(n)
        inside = words.doc[starts] == words.doc[starts + WINDOW - 1]
        twice = np.zeros(n, dtype=np.int8)
        for k in range(SPAN):
            twice += grams[k : k + n] == least
        edge = np.r_[True, (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | ~inside[:-1]] & inside
        begin = np.flatnonzero(edge)
        if not len(begin):
            return None
        # a path ends before the next one, and where windows leave the document
        last = (words.first + words.count - WINDOW)[words.doc[begin]]
        end = np.minimum(np.r_[begin[1:], n], last + 1)
        length = end - begin
        body = rolling.span(begin, end + WINDOW - 1) ^ _mix(length.astype(np.uint64))
        many = np.maximum.reduceat(twice, begin) > 1
        doc = words.doc[begin]
        return least[begin].view(np.int64), body.view(np.int64), ids[doc], keys[doc], (begin - words.first[doc]).astype(np.int32), length.astype(np.int32), many | (length > SPAN)

    return map_texts(docs.where("doc_id is not null"), "text", "gram long, body long, doc_id long, _text long, start int, n int, twice boolean", work, _SLICE)


def windows(docs: DataFrame) -> DataFrame:
    """Windows of documents with ``spans`` (start, n): two hashes and their place."""

    def work(batch):
        words = Words(texts(batch))
        spans = batch.column("spans").to_pylist()
        begin = [words.first[i] + s["start"] for i, own in enumerate(spans) for s in own]
        length = np.array([s["n"] for own in spans for s in own], dtype=np.int64)
        if not len(length):
            return None
        starts = np.repeat(np.array(begin) - np.cumsum(length) + length, length) + np.arange(length.sum())
        one, two = (Rolling(words.hashes, b).span(starts, starts + WINDOW).view(np.int64) for b in _BASE)
        doc = words.doc[starts]
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_text"))
        return one, two, ids[doc], keys[doc], (starts - words.first[doc]).astype(np.int32)

    return map_texts(docs, "text", "one long, two long, doc_id long, _text long, start int", work, _SLICE)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, _text, start, n: runs of windows that also start earlier."""
    docs = keyed(docs)
    every = paths(docs)
    # counting alone first, in the shortest rows: nearly all grams stand in one place only and end here
    grams = every.groupBy("gram").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1).cast("int")).alias("places")).where("places > 1").select("gram")
    least = F.min(F.struct(*_PLACE)).alias("first")
    later = F.struct(*_PLACE) != F.col("first")
    with Stash(docs.sparkSession) as late:
        with Stash(docs.sparkSession) as early:
            # what a join gets from an aggregation is stored first: the join then deals both sides itself, and Spark can split a hot key
            grams = early.put(grams)
            found = early.put(every.join(grams, "gram", "left_semi"))
            first = early.put(found.groupBy("gram", "body").agg(least, F.min("n").alias("n"), F.max("twice").alias("again"), F.count("*").alias("copies")))
            whole = late.put(found.join(first.where("copies > 1").select("gram", "body", "first"), ["gram", "body"]).where(later).select(*_PLACE, "n"))
            named = early.put(first.groupBy("gram").agg((F.min("body") != F.max("body")).alias("branching"), F.max("again").alias("again")).where("branching or again").select("gram"))
            open_ = first.join(named, "gram", "left_semi").select("first.*", "n")
            spans = open_.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
            opened = late.put(windows(docs.join(spans, ["doc_id", "_text"])))
        earliest = late.put(opened.groupBy("one", "two").agg(least, F.count("*").alias("_n")).where("_n > 1"))
        single = opened.join(earliest, ["one", "two"]).where(later).select(*_PLACE, F.lit(1).alias("n"))
        return cut(whole.unionByName(single))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_spans``: an array of (start, n), null if nothing repeats.

    A document's runs are at most as many as its words.
    """
    runs = repeats(spread(docs))
    mine = runs.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    return docs.join(mine, (docs["doc_id"] == mine["_id"]) & (F.xxhash64(docs["text"]) == mine["_key"]), "left").drop("_id", "_key")


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start = np.array([s["start"] for s in spans])
    end = start + WINDOW - 1 + np.array([s["n"] for s in spans])
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(end, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``; all columns and rows stay.

    A text that loses words is what is kept, joined by single spaces; any other
    text is unchanged, white space included. ``n_chars`` follows if it is there.
    """
    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            out.append(t if t is None or s is None or not len(s) else b" ".join(kept_words(t.encode().split(), list(s))).decode())
        return pd.Series(out, dtype=object)

    sealed, open_ = set_apart(docs, "doc_id", "text", "n_chars")
    out = with_repeats(sealed)
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cleaned("text", "_spans"))
    out = out.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return open_(out)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def work(batch):
        n_words, removed, sha = [], [], []
        for text, spans in zip(texts(batch), batch.column("_spans").to_pylist(), strict=True):
            words = text.split()
            kept = kept_words(words, spans)
            n_words.append(len(words))
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), sha

    return map_texts(docs, "text", "doc_id long, n_words long, n_removed long, kept_sha256 string", work, _SLICE)


OP8_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 18)) AS s, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM win),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE k > 1),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS gone FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
k AS (SELECT p.doc_id, string_agg(ws[i], ' ' ORDER BY i) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.p WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(g.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN k ON w.doc_id = k.doc_id
"""
