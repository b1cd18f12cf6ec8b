"""Helpers shared by the corpus operators: reading, batching, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works on slices of an Arrow batch of about so many bytes of text, so
#: that memory depends on the longest document and not on the rows of a batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; choose one only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="strandwise-checkpoint-"))


#: Rows of an Arrow batch while a stashed table is made: its buffers lie outside the heap, on both sides of the pipe.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.

    Shuffle files of what lies behind are removed once the copy is written, as
    nothing reads them again. Earlier checkpoints that nothing names go when the
    JVM notices, which the two collections below bring forward (``free``; small
    tables do without).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN, before)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


class Stash:
    """Tables written as Parquet to the shared checkpoint folder, removed when they have served.

    Like ``cut``, for larger tables: Parquet takes about a third of a checkpoint's bytes.
    As a context it removes them in any case, failures included.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stash-{uuid.uuid4().hex}"
        self.number = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, row_group: int | None = None) -> DataFrame:
        path = f"{self.top}/{self.number}"
        self.number += 1
        before = self.spark.conf.get(_CLEAN, "false")
        rows = self.spark.conf.get(_ROWS)
        self.spark.conf.set(_CLEAN, "true")
        self.spark.conf.set(_ROWS, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        try:
            (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
            self.spark.conf.set(_ROWS, rows)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def forget(self, df: DataFrame) -> None:
        """Remove one table of ``put``, which nothing reads any more."""
        remove_folder(self.spark, self.paths.pop(id(df)))

    def __enter__(self) -> Stash:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        """All of them; nothing may read them any more."""
        remove_folder(self.spark, self.top)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes in ``column``."""
    if batch.num_rows == 0:
        return
    sizes = batch.column(column)
    if isinstance(sizes, pa.ChunkedArray):
        sizes = sizes.combine_chunks()
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give back to the system what this Python worker no longer uses.

    A worker stays for later tasks and would hold the most that any task took,
    beside stages of its executor that need no Python.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], dict | None], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices; ``work`` returns columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                got = work(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)], schema=arrow)
                part = got = None
            batch = None
        release()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """More partitions for a table of one file, so that all cores have work.

    Files of many splits are left as they are: they need no shuffle.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 < want else df


def set_apart(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``docs`` with all columns but ``known`` in one struct, a function that takes them out again).

    So no column of the input can have the name of one that an operator adds.
    """
    others = [c for c in docs.columns if c not in known]
    sealed = docs.select(*(c for c in docs.columns if c in known), F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")) if others else docs

    def open_(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(c) if c in known else F.col("_others").getField(c).alias(c) for c in docs.columns))

    return sealed, open_


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def crc_of_id(column: str = "doc_id"):
    """CRC-32 of the id written as decimal text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
