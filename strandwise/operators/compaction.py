"""Compact storage: k-mers that share a minimizer joined into super-k-mers again.

Inside a minimizer's k-mers, a column holds those in which the minimizer
stands at the same place. k-mers of neighbouring columns that overlap by k - 1
bases can be joined; which of them are is the longest chain of pairs that rises
in both sorted columns, so the merged list stays sorted. Chains run over whole
columns. The set of k-mers is unchanged.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet, hashing
from .kmers import check_k
from .minimizers import minimizer_of

#: k-mers of one minimizer in one task at most; more are dealt to parts, which only lengthens the result.
PART = 200_000


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence rising strictly in both coordinates, by patience sorting."""
    ordered = sorted(pairs, key=lambda p: (p[0], -p[1]))
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(ordered):
        k = bisect_left(ends, y)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(y)
            at.append(i)
        else:
            ends[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(ordered[i])
        i = before[i]
    return out[::-1]


def chain_by_tree(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same length by a prefix-maximum tree over the second coordinate."""
    ranks = {y: i + 1 for i, y in enumerate(sorted({y for _, y in pairs}))}
    tree = [(0, -1)] * (len(ranks) + 1)
    ordered = sorted(pairs, key=lambda p: (p[0], -p[1]))
    length, before = [], []
    for i, (_, y) in enumerate(ordered):
        k, best = ranks[y] - 1, (0, -1)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        length.append(best[0] + 1)
        before.append(best[1])
        k = ranks[y]
        while k < len(tree):
            tree[k] = max(tree[k], (length[i], i))
            k += k & -k
    i = max(range(len(length)), key=length.__getitem__, default=-1)
    out = []
    while i >= 0:
        out.append(ordered[i])
        i = before[i]
    return out[::-1]


def join_columns(columns: dict[int, list[str]]) -> list[tuple[str, int]]:
    """(sequence, column of its first k-mer) from sorted k-mers by minimizer place.

    A k-mer of place c is followed by one of place c - 1.
    """
    done: list[tuple[str, int]] = []
    open_: list[tuple[str, int, str]] = []  # sequence, first place, last k-mer
    for place in sorted(columns, reverse=True):
        own = columns[place]
        if open_ and previous == place + 1:  # noqa: F821
            heads: dict[str, list[int]] = {}
            for j, x in enumerate(own):
                heads.setdefault(x[:-1], []).append(j)
            pairs = [(i, j) for i, (_, _, last) in enumerate(open_) for j in heads.get(last[1:], ())]
            chain = dict(longest_chain(pairs))
        else:
            chain = {}
        taken = {j: i for i, j in chain.items()}
        done += [(s, p) for i, (s, p, _) in enumerate(open_) if i not in chain]
        open_ = [(open_[taken[j]][0] + x[-1], open_[taken[j]][1], x) if j in taken else (x, place, x) for j, x in enumerate(own)]
        previous = place
    return done + [(s, p) for s, p, _ in open_]


def compact(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """minimizer, seq, pref, suff, n_kmers from a table of distinct ``kmer``."""
    check_k(k, m)
    framed = kmers.select(minimizer_of("kmer", k, m).alias("f"), "kmer").select("f.framed", "f.j", "kmer")
    # in the minimizer's own orientation its place counts from the other end where the strand turned
    rows = framed.select("framed", F.when(F.col("framed") == F.col("kmer"), F.col("j")).otherwise(k - m - F.col("j")).alias("place"))
    rows = rows.withColumn("minimizer", F.substring(F.col("framed"), F.col("place") + 1, F.lit(m)))
    sized = rows.groupBy("minimizer").count().where(F.col("count") > PART).select("minimizer", F.ceil(F.col("count") / PART).alias("parts"))
    rows = rows.join(sized, "minimizer", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("framed"), F.col("parts")), F.lit(0)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        columns = {int(p): sorted(x) for p, x in group.groupby("place")["framed"]}
        out = join_columns(columns)
        name = group["minimizer"].iloc[0]
        return pd.DataFrame({"minimizer": name, "seq": [s for s, _ in out], "pref": [p for _, p in out], "suff": [len(s) - p - m for s, p in out], "n_kmers": [len(s) - k + 1 for s, _ in out]})

    return rows.groupBy("minimizer", "part").applyInPandas(run, "minimizer string, seq string, pref int, suff int, n_kmers int")


def kmers_of(compacted: DataFrame, k: int) -> DataFrame:
    """kmer: the canonical k-mers of compact records."""
    return compacted.select(F.explode(F.sequence(F.lit(0), F.col("n_kmers") - 1)).alias("i"), "seq").select(alphabet.canonical(F.substring(F.col("seq"), F.col("i") + 1, F.lit(k))).alias("kmer"))


def stream_digest(skmers: DataFrame) -> int:
    """FNV-1a over super-k-mers in the order of records and starts; streams rows through the driver."""
    ordered = skmers.orderBy("record_id", "start").select("seq", "pref", "suff")
    h = hashing.fnv1a([])
    for r in ordered.toLocalIterator():
        h = hashing.fnv1a([f"{r['seq']} {r['pref']} {r['suff']}\n"], h)
    return h
