"""Sequence records: ``record_id`` and ``seq``."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.batches import sliced

SCHEMA = "record_id string, seq string"


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTA files, plain or gzipped; a record is one row, its id the header's first word.

    Plain files are split between tasks at record starts. Lines of a sequence
    are joined; carriage returns and spaces are dropped.
    """
    raw = spark.read.option("lineSep", ">").text(path)
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 1, F.length("value"))
    rows = raw.where(F.trim(F.translate("value", "\r\n", "  ")) != "")
    return rows.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("record_id"), F.translate(body, "\r\n\t ", "").alias("seq"))


def from_table(df: DataFrame, record_id: str, seq: str | Column) -> DataFrame:
    """Records of any table; null texts are dropped."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return df.select(F.col(record_id).cast("string").alias("record_id"), seq.alias("seq")).where(F.col("seq").isNotNull())


def from_letters(df: DataFrame, record_id: str | Column, text: str) -> DataFrame:
    """Records of a table of texts: the ASCII letters of a text, each read as a base; null texts are dropped.

    The same as ``alphabet.letters_as_bases``, by a table of bytes over Arrow
    batches, which costs a small part of a regular expression's time. Texts are
    translated in C one by one and leave in slices, so a task holds little more
    than the batch it reads.
    """
    letters = alphabet.LETTERS.encode()
    base = bytes(ord(alphabet.BITS_TO_BASE[(b >> 1) & 3]) for b in range(256))
    other = bytes(b for b in range(256) if b not in letters)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                seq = pa.array([t.translate(base, other) for t in part.column("text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("record_id"), seq], names=["record_id", "seq"])

    record_id = F.col(record_id) if isinstance(record_id, str) else record_id
    rows = df.select(record_id.cast("string").alias("record_id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, SCHEMA)


def from_strings(spark: SparkSession, strings: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(strings)], SCHEMA)


def sanitize(records: DataFrame) -> DataFrame:
    """Upper case, parted at runs of anything but ACGT; fragments are named <id>_<number from 0>."""
    parts = F.filter(F.split(F.upper("seq"), "[^ACGT]+"), lambda x: x != "")
    return records.select("record_id", F.posexplode(parts).alias("i", "part")).select(F.concat_ws("_", "record_id", "i").alias("record_id"), F.col("part").alias("seq"))


def at_least(records: DataFrame, k: int) -> DataFrame:
    """Records of k bases or more; shorter ones hold no k-mer."""
    return records.where(F.length("seq") >= k)


def prefix(records: DataFrame, n: int) -> DataFrame:
    """The first n bases over all records in the order of their ids; the last one is cut.

    Lengths alone are dealt, to ranges of ids that a sample of ids balances, and
    summed by range and then inside the ranges; texts are joined for what is kept.
    """
    from pyspark.sql import Window

    from .shared import shared_folder

    shared_folder(records.sparkSession)
    sized = records.select("record_id", F.length("seq").cast("long").alias("n"), F.xxhash64("seq").alias("h"))
    ranged = sized.repartitionByRange("record_id").withColumn("part", F.spark_partition_id()).checkpoint()
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranged.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("record_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranged.join(base.where(F.col("base") < n), "part")
    left = F.lit(n) - F.col("base") - F.coalesce(F.sum("n").over(inner), F.lit(0))
    wanted = begun.withColumn("left", left).where("left > 0").select("record_id", "h", F.least("left", "n").cast("int").alias("left"))
    return records.withColumn("h", F.xxhash64("seq")).join(wanted, ["record_id", "h"]).select("record_id", F.substring(F.col("seq"), F.lit(1), F.col("left")).alias("seq"))


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "record_id", F.lit("\n"), "seq")).write.text(path)
