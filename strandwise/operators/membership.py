"""Which k-mers of sequences are in a set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch
from . import kmers as K

#: A set of at most so many keys is sent to all executors (about 64 MB); larger ones are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def presence(records: DataFrame, keys: DataFrame, k: int, keys_in_set: int | None = None) -> DataFrame:
    """record_id, pos, kmer, present for every k-mer position.

    ``keys_in_set``: the set's size if it is known (stores know it), which lets
    a small set be broadcast.
    """
    if k <= 31:
        rows = K.kmer_codes(records, k).withColumnRenamed("code", "key")
    else:
        rows = K.kmer_strings(K.dealt(records), k).withColumnRenamed("kmer", "key")
    marked = keys.select("key", F.lit(True).alias("_in"))
    if keys_in_set is not None and keys_in_set <= BROADCAST_KEYS:
        marked = F.broadcast(marked)
    return rows.join(marked, "key", "left").select("record_id", "pos", K.as_kmer("key", k).alias("kmer"), F.col("_in").isNotNull().alias("present"))


def known(records: DataFrame, others: DataFrame, k: int) -> K.Known | DataFrame:
    """The k-mers of ``records`` that ``others`` have too: as a set for executors if they are ``BROADCAST_KEYS`` at most, else stored, as ``key``.

    If ``records`` have so few, the others are filtered where they are read, so
    their set is never made. Else both sets meet in sorted blocks once.
    """
    if k > 31:
        return K.key_set(others, k)
    own = K.collected(records, k, BROADCAST_KEYS)
    if own is not None:
        return K.collected(others, k, BROADCAST_KEYS, own)
    spark = records.sparkSession
    path = scratch(spark)
    K.pair_flags(records, others, k, ("both",)).select("key").write.parquet(path)
    shared = spark.read.schema("key long").parquet(path)
    return shared if shared.count() > BROADCAST_KEYS else K.Known(shared.toArrow().column("key").to_numpy())


def presence_among(records: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """``presence`` of the k-mers of ``records`` among those of other records, whose set is not stored."""
    hit = known(records, others, k)
    if isinstance(hit, DataFrame):
        return presence(records, hit, k)
    return K.kmer_codes(records, k, hit).select("record_id", "pos", K.as_kmer("code", k).alias("kmer"), "present")


def _each_piece(records: DataFrame, k: int, hit: K.Known, schema: str, work) -> DataFrame:
    """``work(flags)`` for each piece of a record, with its id and first k-mer."""
    names = ["record_id", "at", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            for rows, lengths, codes in K.laid(batch, k):
                flags = hit(K.canonical_codes(codes, k)[0])
                first = np.cumsum(lengths) - lengths
                out = [work(flags[a : a + n - k + 1]) for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("record_id").take(own), batch.column("at").take(own), *map(pa.array, zip(*out, strict=True))], names=names)

    return K.dealt(K.pieces(records, k)).mapInArrow(run, f"record_id string, at int, {schema}")


def summary_among(records: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """``summary``, counted where records are read."""
    hit = known(records, others, k)
    if isinstance(hit, DataFrame):
        return summary(presence(records, hit, k))
    parts = _each_piece(records, k, hit, "n long, p long", lambda f: (len(f), int(f.sum())))
    return parts.groupBy("record_id").agg(F.sum("n").alias("n_kmers"), F.sum("p").alias("n_present"))


def lines_among(records: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """``lines``; a record's flags meet as one text for each piece."""
    hit = known(records, others, k)
    if isinstance(hit, DataFrame):
        return lines(presence(records, hit, k))

    def text(flags):
        out = np.full(2 * len(flags) - 1, ord(","), dtype=np.uint8)
        out[::2] = ord("0") + flags
        return (out.tobytes().decode(),)

    parts = _each_piece(records, k, hit, "part string", text)
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return parts.groupBy("record_id").agg(F.concat_ws(",", F.transform(ordered, lambda x: x["part"])).alias("line"))


def lines(found: DataFrame) -> DataFrame:
    """record_id, line: flags of a record in order, joined by commas."""
    flags = F.transform(F.array_sort(F.collect_list(F.struct("pos", "present"))), lambda x: x["present"].cast("int").cast("string"))
    return found.groupBy("record_id").agg(F.concat_ws(",", flags).alias("line"))


def grouped_lines(found: DataFrame, skmers: DataFrame) -> DataFrame:
    """record_id, start, line: one line for each super-k-mer, flags in its canonical direction."""
    m = F.length("minimizer")
    turned = F.substring(F.col("seq"), F.col("pref") + 1, m) != F.col("minimizer")
    cells = skmers.select("record_id", "start", turned.alias("turned"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_kmers") - 1)).alias("pos"))
    joined = cells.join(found.select("record_id", "pos", "present"), ["record_id", "pos"])
    flags = F.transform(F.array_sort(F.collect_list(F.struct("pos", "present"))), lambda x: x["present"].cast("int").cast("string"))
    by = joined.groupBy("record_id", "start").agg(flags.alias("flags"), F.first("turned").alias("turned"))
    return by.select("record_id", "start", F.concat_ws(",", F.when(F.col("turned"), F.reverse("flags")).otherwise(F.col("flags"))).alias("line"))


def missing(found: DataFrame) -> DataFrame:
    """kmer: distinct k-mers that the set lacks."""
    return found.where(~F.col("present")).select("kmer").distinct()


def summary(found: DataFrame) -> DataFrame:
    """record_id, n_kmers, n_present."""
    return found.groupBy("record_id").agg(F.count("*").alias("n_kmers"), F.sum(F.col("present").cast("long")).alias("n_present"))


def overlaps(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """left, right: k-mers as read whose last and first k - 1 bases agree."""
    left = a.select(F.col("kmer").alias("left"), F.substring(F.col("kmer"), 2, k - 1).alias("_o"))
    right = b.select(F.col("kmer").alias("right"), F.substring(F.col("kmer"), 1, k - 1).alias("_o"))
    return left.join(right, "_o").drop("_o")
