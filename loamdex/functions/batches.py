"""Batches inside tasks, in portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and items of lists, that a step inside a task handles; a longer row is a step of its own.
TEXT_BYTES, ITEMS = 1 << 20, 1 << 18


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text or items of each list; null has none."""
    count = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(count(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows that hold at most so much together, or are one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def portions(batches: Iterable[pa.RecordBatch], *columns: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches by what their columns of texts hold: a batch has up to so many rows, but rows of any length."""
    for batch in batches:
        for begin, end in cuts(sum(lengths(batch.column(c)) for c in columns), most or TEXT_BYTES):
            yield batch.slice(begin, end - begin)
