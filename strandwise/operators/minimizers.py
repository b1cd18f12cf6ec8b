"""Minimizers and super-k-mers.

The minimizer of a k-mer is its m-mer of least ``phi`` (of the canonical
code); of equal ones the most central, then the one whose k-mer, read in the
minimizer's own orientation, is smaller, then the first. The choice is the
same on both strands. A super-k-mer is the longest run of k-mers in a record
that have the same occurrence as their minimizer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alphabet, hashing
from ..functions.batches import SLICE, sliced
from . import kmers as K
from .kmers import base_codes, canonical_codes, check_k, dealt

_LETTERS = np.frombuffer(b"ACGT", dtype=np.uint8)


def choose(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each k-mer of one sequence, where its minimizer begins."""
    canonical, forward = canonical_codes(codes, m)
    rank = hashing.phi(canonical, m)
    n, span = len(codes) - k + 1, k - m
    best = rank[:n].copy()
    off = np.full(n, span, dtype=np.int64)
    place = np.zeros(n, dtype=np.int64)
    tied = np.zeros(n, dtype=bool)
    for j in range(1, span + 1):
        r, c = rank[j : j + n], abs(2 * j - span)
        equal = r == best
        better = (r < best) | equal & (c < off)
        tied = np.where(better, False, tied | equal & (c == off) & (c > 0))
        best, off, place = np.where(better, r, best), np.where(better, c, off), np.where(better, j, place)
    where = np.arange(n) + place
    for i in np.flatnonzero(tied).tolist():  # two occurrences as far from the centre
        own = codes[i : i + k]
        back = (3 - own)[::-1]
        j = int(place[i])
        read = lambda at: (own if forward[i + at] else back).tobytes()  # noqa: E731, B023
        if read(span - j) < read(j):
            where[i] = i + span - j
    return where


def _spans(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, letters end to end) of spans of ``codes``."""
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return length, _LETTERS[codes[at]]


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    lengths = np.concatenate([n for n, _ in parts])
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate([x for _, x in parts]).tobytes()))


def superkmers(records: DataFrame, k: int, m: int) -> DataFrame:
    """record_id, start, seq, pref, suff, minimizer, n_kmers.

    pref and suff: bases of ``seq`` before and after the minimizer. A piece of a
    long record has one k-mer more before and as many after its own as a run can
    reach, and gives the runs that begin in it.
    """
    check_k(k, m)
    if m > 31:
        raise ValueError("minimizers hold 31 bases at most")
    schema = "record_id string, start int, seq string, pref int, suff int, minimizer string, n_kmers int"
    piece = K.PIECE

    def run(batches):
        for batch in (part for whole in batches for part in sliced(whole, "seq")):
            rows, starts, seqs, pref, suff, low, count, held = [], [], [], [], [], [], [], 0
            for i, (at, seq) in enumerate(zip(batch.column("at").to_pylist(), batch.column("seq").to_pylist(), strict=True)):
                codes = base_codes(seq)
                lead = int(at > 0)
                where = choose(codes, k, m)
                edge = np.r_[True, where[1:] != where[:-1]]
                begin = np.flatnonzero(edge)
                n = np.diff(np.r_[begin, len(where)])
                own = (begin >= lead) & (begin < lead + piece)
                begin, n = begin[own], n[own]
                if not len(begin):
                    continue
                w = where[begin]
                length = n + k - 1
                # the minimizer reads forward or, from the other end, on the other strand
                forward = canonical_codes(codes, m)[1][w]
                j = np.arange(m)
                letters = np.where(forward[:, None], codes[w[:, None] + j], 3 - codes[w[:, None] + m - 1 - j])
                rows.append(np.full(len(begin), i))
                starts.append(begin + at - lead)
                seqs.append(_spans(codes, begin, length))
                pref.append(w - begin)
                suff.append(begin + length - w - m)
                low.append((np.full(len(begin), m), _LETTERS[letters].ravel()))
                count.append(n)
                held += int(length.sum())
                if held > 4 * SLICE:
                    yield _table(batch, rows, starts, seqs, pref, suff, low, count)
                    rows, starts, seqs, pref, suff, low, count, held = [], [], [], [], [], [], [], 0
            if rows:
                yield _table(batch, rows, starts, seqs, pref, suff, low, count)

    names = [c.split()[0] for c in schema.split(", ")]

    def _table(batch, rows, starts, seqs, pref, suff, low, count):
        ints = lambda x: pa.array(np.concatenate(x).astype(np.int32))
        ids = batch.column("record_id").take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([ids, ints(starts), _strings(seqs), ints(pref), ints(suff), _strings(low), ints(count)], names=names)

    return dealt(K.pieces(records, k, 1, k - m + 1)).mapInArrow(run, schema)


def minimizer_of(kmer, k: int, m: int):
    """struct(rank, off, framed, j) of a k-mer string's minimizer, as an expression; m <= 15."""
    check_k(k, m)
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer

    def candidate(j):
        word = F.substring(kmer, j + 1, F.lit(m))
        return F.struct(hashing.phi(alphabet.code(alphabet.canonical(word), m), m).alias("rank"), F.abs(2 * j - (k - m)).alias("off"), F.when(alphabet.is_forward(word), kmer).otherwise(alphabet.revcomp(kmer)).alias("framed"), j.alias("j"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(k - m)), candidate))


def superkmers_by_islands(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """The same runs from a table of k-mers as read (record_id, pos, raw), by windows over records.

    For records of bounded length: a window holds all k-mers of one record.
    """
    best = kmers.withColumn("_m", minimizer_of("raw", k, m)).withColumn("occ", F.col("pos") + F.col("_m.j"))
    by = Window.partitionBy("record_id").orderBy("pos")
    new = F.when(F.col("occ") == F.lag("occ").over(by), 0).otherwise(1)
    numbered = best.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("record_id", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n_kmers"), F.first("occ").alias("occ")).drop("run")


def explode_superkmers(skmers: DataFrame, k: int) -> DataFrame:
    """record_id, pos, kmer (canonical) of every k-mer in super-k-mers."""
    rows = skmers.select("record_id", "seq", "start", F.explode(F.sequence(F.lit(0), F.col("n_kmers") - 1)).alias("i"))
    return rows.select("record_id", (F.col("start") + F.col("i")).alias("pos"), alphabet.canonical(F.substring(F.col("seq"), F.col("i") + 1, F.lit(k))).alias("kmer"))


def canonical_superkmers(skmers: DataFrame) -> DataFrame:
    """Super-k-mers turned so that their minimizer reads as its canonical form; flanks swap with the strand."""
    m = F.length("minimizer")
    stands = F.substring(F.col("seq"), F.col("pref") + 1, m) == F.col("minimizer")
    return skmers.withColumns({"seq": F.when(stands, F.col("seq")).otherwise(alphabet.revcomp("seq")), "pref": F.when(stands, F.col("pref")).otherwise(F.col("suff")), "suff": F.when(stands, F.col("suff")).otherwise(F.col("pref"))})


def with_bucket(df: DataFrame, m: int, buckets: int, minimizer: str = "minimizer") -> DataFrame:
    """``bucket``: the leading bits of the reversed hash, buckets rounded down to a power of two; m <= 15."""
    b = hashing.bucket_bits(m, buckets)
    return df.withColumn("bucket", F.shiftright(hashing.psi(alphabet.code(minimizer, m), m), 2 * m - b).cast("int"))


def histogram(skmers: DataFrame, m: int, bits: int) -> DataFrame:
    """bucket, n_superkmers, n_kmers for the leading ``bits`` bits."""
    return with_bucket(skmers, m, 1 << bits).groupBy("bucket").agg(F.count("*").alias("n_superkmers"), F.sum("n_kmers").alias("n_kmers"))


def ascii_dump(skmers: DataFrame, k: int, m: int) -> DataFrame:
    """Lines ``SEQ pref suff`` of turned super-k-mers; the header is ``k m count``."""
    return canonical_superkmers(skmers).select(F.concat_ws(" ", "seq", "pref", "suff").alias("value"))


def dump_header(skmers: DataFrame, k: int, m: int) -> str:
    return f"{k} {m} {skmers.count()}"
