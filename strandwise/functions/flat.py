"""Arrow string columns as one flat byte array, for vectorised kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a string column, one byte each, and the rows' offsets.

    Null counts as empty.  A letter outside ASCII becomes one ``?``, so that
    offsets always count letters.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets, data = _buffers(column)
    if data.size and data.max() >= 0x80:
        plain = [s.encode("ascii", "replace") for s in column.to_pylist()]
        offsets, data = _buffers(pa.array(plain, pa.large_binary()))
    return data, offsets


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(column)
    _, off, values = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, letters: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``letters`` letters (a row at least), which stay in the processor's cache."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        lengths = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // letters
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), b.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield b.slice(start, stop - start)


def _upper_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] -= 32
    return t


def _code_table() -> np.ndarray:
    t = np.full(256, 4, np.uint8)
    for i, c in enumerate("ACGT"):
        t[ord(c)] = t[ord(c.lower())] = i
    return t


#: Letter to upper case.
UPPER = _upper_table()
#: Letter to base number in alphabetical order; 4 for anything but A, C, G, T.
BASE = _code_table()


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row to which each flat position belongs."""
    return np.searchsorted(offsets, positions, side="right") - 1
