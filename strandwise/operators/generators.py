"""Seeded data for tests and benchmarks: k-mers, reads, mutated genomes, query sets."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet


def random_dna(n: int, seed: int) -> str:
    """n bases from a xorshift generator."""
    x, out = seed & 0xFFFFFFFFFFFFFFFF or 1, []
    for _ in range(n):
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        out.append("ACGT"[x & 3])
    return "".join(out)


def random_kmers(spark: SparkSession, n: int, k: int, seed: int = 1) -> DataFrame:
    """kmer: n canonical k-mers, each base from a hash of its row and place."""
    base = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select(alphabet.canonical(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(k)), base), "")).alias("kmer"))


def sample_kmers(kmers: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n k-mers uniform over positions, the same in every run."""
    return kmers.orderBy(F.xxhash64(F.lit(seed), "record_id", "pos"), "record_id", "pos").limit(n)


def simulated_reads(records: DataFrame, n: int, length: int, error: float, seed: int = 1) -> DataFrame:
    """record_id, seq: n reads from records of ``length`` bases or more, with substitutions."""
    long = records.where(F.length("seq") >= length)
    per = F.ceil(F.lit(n) / F.lit(max(1, long.count()))).cast("int")
    rows = long.select("record_id", "seq", F.explode(F.sequence(F.lit(1), per)).alias("i"))
    at = F.pmod(F.xxhash64(F.lit(seed), "record_id", "i"), F.length("seq") - length + 1).cast("int")
    reads = rows.select(F.concat_ws("_", "record_id", "i").alias("record_id"), F.substring(F.col("seq"), at + 1, F.lit(length)).alias("seq"))
    return mutate(reads.orderBy(F.xxhash64(F.lit(seed), "record_id")).limit(n), error, seed)


def mutate(records: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each base replaced by another with probability ``rate``."""
    h = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("record_id"), i), F.lit(1 << 30))

    def base(x, i):
        old = F.instr(F.lit("ACGT"), x) - 1
        new = F.pmod(old + 1 + F.pmod(h(-i), F.lit(3)), F.lit(4)).cast("int")
        return F.substring(F.lit("ACGT"), F.when(h(i) < int(rate * (1 << 30)), new).otherwise(old) + 1, F.lit(1))

    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    return records.select("record_id", F.array_join(F.transform(letters, lambda x, i: base(x, i + 1)), "").alias("seq"))


def rate_for_jaccard(j: float, k: int) -> float:
    """Mutation rate that gives two genomes' k-mer sets a Jaccard index of about ``j``."""
    return 1 - (2 * j / (1 + j)) ** (1 / k)


def query_mix(kmers: DataFrame, n: int, present: float, k: int, seed: int = 1) -> DataFrame:
    """kmer: a share ``present`` taken from ``kmers``, the rest random; shuffled."""
    spark = kmers.sparkSession
    hit = math.floor(n * present)
    return shuffle_rows(sample_kmers(kmers, hit, seed).select("kmer").unionByName(random_kmers(spark, n - hit, k, seed + 1)), "kmer", seed)


def shuffle_rows(df: DataFrame, column: str, seed: int = 1) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), column))


def lines_to_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records named seq<number> from a table of strings."""
    return lines.select(F.concat(F.lit("seq"), F.monotonically_increasing_id().cast("string")).alias("record_id"), F.col(column).alias("seq"))


def shuffled(items: list, seed: int) -> list:
    out = list(items)
    random.Random(seed).shuffle(out)
    return out
