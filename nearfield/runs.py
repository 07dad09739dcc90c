"""Runs of equal keys in a stream of sorted Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa


def trim() -> None:
    """Returns freed memory to the system. Spark keeps Python workers, and what one stage freed would count against the next."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """A function over Arrow batches that trims memory after each batch that it gives."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(run(batches)):
            yield b
            if n % 16 == 15:
                trim()
        trim()

    return out


def complete_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): tables that hold whole runs of the key columns, which are long and sorted, and where each run starts.

    A run that a batch's end cuts waits for the next batch, so memory is bounded by a batch and the longest run.
    """
    left: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        starts = _starts(t, keys)
        if len(starts):
            if starts[-1] > 0:
                yield t.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            left = t.slice(starts[-1])
    if left is not None and left.num_rows:
        yield left.combine_chunks(), np.zeros(1, np.int64)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    if not t.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
