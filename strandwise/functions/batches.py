"""Arrow batches in parts of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Python works on parts of an Arrow batch of about so many bytes, so that its
#: memory depends neither on the rows of a batch nor on the size of a table.
SLICE = 1 << 20


def sliced(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes in ``column``, or of one row."""
    limit = SLICE if limit is None else limit
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
