"""Runs of consecutive equal events, collapsed into one event each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import BASE, UPPER, flat_letters, rows_of


def _doubtful(letters: np.ndarray, offsets: np.ndarray, qual: pa.Array, worst: int) -> np.ndarray:
    """Positions of quality ``worst`` or less in rows whose qual has one letter for each base."""
    marks, mark_offsets = flat_letters(qual)
    n, m = np.diff(offsets), np.diff(mark_offsets)
    usable = (n == m) & (n > 0)
    low = np.zeros(len(letters), bool)
    low[np.repeat(usable, n)] = marks[np.repeat(usable, m)].astype(np.int16) - 33 <= worst
    return low


def boundaries(seq: pa.Array, qual: pa.Array, worst: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, length and letter of every run of equal letters.

    Only boundary positions are kept: those that differ from their predecessor
    or begin a read.  The next boundary (the lead over starts) gives the length.
    """
    raw, offsets = flat_letters(seq)
    letters = UPPER[raw]
    begins = np.zeros(len(letters) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    if len(letters) > 2 and worst >= 0:
        ends = np.zeros(len(letters) + 1, bool)
        ends[offsets[1:]] = True
        inner = ~begins[1:-1] & ~ends[2:-1]
        mend = inner & (letters[:-2] == letters[2:]) & (BASE[letters[:-2]] < 4) & _doubtful(letters, offsets, qual, worst)[1:-1]
        mended = letters.copy()
        mended[1:-1][mend] = letters[:-2][mend]
        letters = mended
    change = begins.copy()
    change[1:] |= letters[1:] != letters[:-1]
    starts = np.flatnonzero(change)
    lengths = np.diff(np.append(starts, len(letters)))
    rows = rows_of(offsets, starts)
    return rows, starts - offsets[rows], lengths, letters[starts]


def _long_runs(least: int, worst: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, lengths, letters = boundaries(b.column(1), b.column(2), worst)
            keep = (lengths >= least) & (BASE[letters] < 4)
            bases = letters[keep].view("S1").astype("U1") if keep.any() else np.zeros(0, "U1")
            start, length = starts[keep].astype(np.int32), lengths[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[keep])), pa.array(bases.tolist(), pa.string()), pa.array(start), pa.array(length), pa.array(start + length)], names=["read_id", "base", "run_start", "run_len", "run_end"])

    return run


def base_runs(reads: DataFrame, least: int = 1, worst: int = 5, id_col: str = "read_id", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One row for each run of at least ``least`` equal bases A, C, G or T.

    Columns ``read_id, base, run_start, run_len, run_end``: 0-based start, count
    of letters, and the first position after the run.  Case is ignored.  A
    position of Phred quality ``worst`` or less between two equal bases counts as
    that base (``worst=-1`` turns this off); qual is used only where it is as long
    as seq.  Null and empty sequences give no rows; other letters end a run; rows
    with one id are reads of their own.  A read's whole sequence is one row, so
    no shuffle and no grouping is needed, however the reads are distributed.
    """
    rows = reads.select(F.col(id_col).alias("read_id"), F.col(seq).cast("string").alias("seq"), F.col(qual).cast("string").alias("qual")).where("seq is not null and seq <> ''")
    id_type = rows.schema["read_id"].dataType.simpleString()
    return rows.mapInArrow(_long_runs(least, worst), f"read_id {id_type}, base string, run_start int, run_len int, run_end int")


def _compressed(worst: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, lengths, letters = boundaries(b.column(1), b.column(2), worst)
            offsets = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (starts, lengths)]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters.tobytes())]).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, *lists], names=["read_id", "events", "starts", "lengths"])

    return run


def collapsed_reads(reads: DataFrame, worst: int = 5, id_col: str = "read_id", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """Each read with all its runs collapsed: ``events`` (one letter a run), ``starts``, ``lengths``.

    Every read keeps its row; null and empty sequences have no events.
    """
    rows = reads.select(F.col(id_col).alias("read_id"), F.col(seq).cast("string").alias("seq"), F.col(qual).cast("string").alias("qual"))
    id_type = rows.schema["read_id"].dataType.simpleString()
    return rows.mapInArrow(_compressed(worst), f"read_id {id_type}, events string, starts array<int>, lengths array<int>")
