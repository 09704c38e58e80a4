"""Slices of Arrow batches by the size of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``most`` bytes of text each; a longer text is alone."""
    total = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(batch.column(column).fill_null("")), np.int64))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
