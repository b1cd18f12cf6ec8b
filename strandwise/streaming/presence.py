"""Membership for unbounded records: a stream of sequences joined with a stored set.

The stream needs no state and no watermark: each record is looked up on its
own. Aggregates over time windows keep state for ``lateness`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers as K
from ..operators.membership import BROADCAST_KEYS


def stream_records(spark: SparkSession, path: str, schema: str, record_id: str, seq: str) -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col(record_id).cast("string").alias("record_id"), F.col(seq).alias("seq")).where(F.col("seq").isNotNull())


def stream_presence(records: DataFrame, keys: DataFrame, k: int, keys_in_set: int | None = None) -> DataFrame:
    """record_id, pos, kmer, present for a streaming table of records."""
    K.check_k(k)
    rows = K.kmer_strings(records, k)
    marked = keys.select(K.as_kmer("key", k).alias("kmer"), F.lit(True).alias("_in"))
    if keys_in_set is not None and keys_in_set <= BROADCAST_KEYS:
        marked = F.broadcast(marked)
    return rows.join(marked, "kmer", "left").select("record_id", "pos", "kmer", F.col("_in").isNotNull().alias("present"))


def stream_summary(found: DataFrame, at: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Present and absent k-mers in each window of the time column ``at``."""
    return found.withWatermark(at, lateness).groupBy(F.window(at, window)).agg(F.count("*").alias("n_kmers"), F.sum(F.col("present").cast("long")).alias("n_present"))
