"""Arrow batches inside tasks: null-safe texts, bounded sub-batches, result batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters of text handled at once inside a task; one longer text makes a batch of its own
BATCH_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges holding at most ``limit`` bytes of ``column`` (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    yield batch.slice(start, n - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def utf8_buffer(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column (null: empty), joined, and the n + 1 row offsets into them."""
    values = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    _, offset_buf, data_buf = values.buffers()
    offsets = np.frombuffer(offset_buf, dtype=np.int64)[values.offset:values.offset + len(values) + 1] \
        if len(values) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, dtype=np.uint8)
    return data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]
