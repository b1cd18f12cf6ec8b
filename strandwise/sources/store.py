"""k-mer sets on disk: Parquet in buckets, with a one-row table that describes them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers as K

VERSION = 1
META = "version int, k int, m int, n_kmers long, n_buckets int, key_type string"


def write_set(keys: DataFrame, path: str, k: int, m: int | None = None, buckets: int = 0) -> int:
    """Store ``key``; returns the number of keys.

    Keys are dealt by hash to ``buckets`` directories (0: none) and sorted
    in files, so that min/max statistics and prefix encoding work.
    """
    K.check_k(k, m)
    spark = keys.sparkSession
    keys = keys.select("key")
    if buckets:
        dealt = keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "key")
        dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/keys")
    else:
        keys.sortWithinPartitions("key").write.mode("errorifexists").parquet(f"{path}/keys")
    n = spark.read.parquet(f"{path}/keys").count()  # from footers
    spark.createDataFrame([(VERSION, k, m or k, n, buckets, "long" if k <= 31 else "string")], META).coalesce(1).write.parquet(f"{path}/meta")
    return n


def read_meta(spark: SparkSession, path: str) -> dict:
    """k, m, n_kmers, n_buckets, version of a stored set; ValueError for anything else."""
    try:
        rows = spark.read.parquet(f"{path}/meta").collect()
    except AnalysisException as e:
        raise ValueError(f"{path} is not a k-mer set") from e
    if len(rows) != 1 or "version" not in rows[0] or rows[0]["version"] != VERSION:
        raise ValueError(f"{path} has another format version")
    return rows[0].asDict()


def read_set(spark: SparkSession, path: str, bucket: int | None = None) -> tuple[DataFrame, dict]:
    """(keys, meta); ``bucket`` reads one directory only."""
    meta = read_meta(spark, path)
    keys = spark.read.schema(f"key {meta['key_type']}" + (", bucket int" if meta["n_buckets"] else "")).parquet(f"{path}/keys")
    if bucket is not None:
        if not 0 <= bucket < meta["n_buckets"]:
            raise ValueError(f"no bucket {bucket}")
        keys = keys.where(F.col("bucket") == bucket)
    return keys.select("key"), meta


def check_compatible(a: dict, b: dict, strict: bool = False) -> None:
    """Sets compare by k; ``strict`` wants the same m and buckets too."""
    fields = ("k", "m", "n_buckets") if strict else ("k",)
    for f in fields:
        if a[f] != b[f]:
            raise ValueError(f"the sets differ in {f}: {a[f]} and {b[f]}")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.text(path)
