"""Helpers of the Arrow passes: slices of batches by bytes, and lists of values gathered by code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text, a single longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gather(codes: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value lists of codes, one after another, as (offsets, values)."""
    sizes = offsets[codes + 1] - offsets[codes]
    out = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(out[-1]) + np.repeat(offsets[codes] - out[:-1], sizes)
    return out, values[at]
