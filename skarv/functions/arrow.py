"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that only so many become Python objects at a time. Empty ones come once."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
