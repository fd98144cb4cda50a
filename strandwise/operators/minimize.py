"""Minimizer extraction: hash-density selection of canonical k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import BASE, UPPER, flat_letters, rows_of, slices
from ..session import materialize

MREADS = "read_id long, minimizers array<bigint>, pos array<int>, dir array<tinyint>, qual array<tinyint>, mean_q double, read_len int"
#: Alphabetical base number to the number with which k-mers are compared (A 0, C 1, T 2, G 3).
_CODE = np.array([0, 1, 3, 2, 0], np.uint64)
_U = np.uint64
#: Multipliers of the MurmurHash3 x64 128-bit function.
C1, C2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)
F1, F2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * F1
    h = (h ^ (h >> _U(33))) * F2
    return h ^ (h >> _U(33))


def murmur64(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Lower half of MurmurHash3 x64 128 of each value's eight bytes."""
    k = values.astype(np.uint64) * C1
    k = ((k << _U(31)) | (k >> _U(33))) * C2
    h2 = np.full_like(k, seed ^ 8)
    h1 = (k ^ _U(seed) ^ _U(8)) + h2
    h2 = h2 + h1
    return _fmix(h1) + _fmix(h2)


def density_bound(density: float) -> float:
    return density * float(2**64 - 1)


def packed_kmers(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement value of each window of two-bit codes.

    Windows of doubled width are put together from two halves, so that a window
    takes as many steps as its length has binary digits.
    """
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def join(left: tuple, w: int, right: tuple, v: int) -> tuple:
        m = len(left[0]) - v
        f, g = left[0][:m] << _U(2 * v), right[1][w : w + m] << _U(2 * w)
        f |= right[0][w : w + m]
        g |= left[1][:m]
        return f, g

    power, width, packed, have = (codes, codes ^ _U(2)), 1, None, 0
    while True:
        if length & width:
            packed, have = (power, width) if packed is None else (join(packed, have, power, width), have + width)
        if have == length:
            return packed[0][:n], packed[1][:n]
        power, width = join(power, width, power, width), 2 * width


def _compress(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run-compressed letters, their offsets, and each one's position in the flat original."""
    change = np.ones(len(letters), bool)
    change[1:] = letters[1:] != letters[:-1]
    change[offsets[:-1][offsets[:-1] < len(letters)]] = True
    starts = np.flatnonzero(change)
    return letters[starts], np.searchsorted(starts, offsets), starts


def _select(length: int, density: float, compress: bool, repetitive: np.ndarray, min_quality: float):
    bound = density_bound(density)
    errors = 10.0 ** (-(np.arange(256) - 33) / 10.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, whole = flat_letters(b.column(1))
            letters, offsets, place = UPPER[raw], whole, None
            if compress:
                letters, offsets, place = _compress(letters, whole)
            base = BASE[letters]
            forward, backward = packed_kmers(_CODE[base], length)
            n = len(forward)
            bad = np.append(0, np.cumsum(base > 3))
            row_end = np.repeat(offsets[1:], np.diff(offsets))[:n]
            row_start = np.repeat(offsets[:-1], np.diff(offsets))[:n]
            at = np.arange(n)
            # The first and the last k-mer of a read are never taken.
            ok = (at > row_start) & (at + length < row_end) & (bad[length:] == bad[:n])
            least = np.minimum(forward, backward)
            pick = np.flatnonzero(ok)
            pick = pick[murmur64(least[pick]).astype(np.float64) < bound]
            if len(repetitive):
                pick = pick[~np.isin(least[pick], repetitive)]
            row = rows_of(offsets, pick)
            # Quality, where qual has a letter for every base.
            marks, mark_offsets = flat_letters(b.column(2))
            lengths, n_marks = np.diff(whole), np.diff(mark_offsets)
            usable = (lengths == n_marks) & (lengths > 0)
            sums = np.append(0.0, np.cumsum(errors[marks]))
            with np.errstate(divide="ignore", invalid="ignore"):
                mean_q = np.where(n_marks > 0, -10 * np.log10((sums[mark_offsets[1:]] - sums[mark_offsets[:-1]]) / n_marks), np.nan)
            if min_quality > 0:
                keep = ~(mean_q < min_quality)[row]
                pick, row = pick[keep], row[keep]
            first = place[pick] if compress else pick
            last = (place[np.minimum(pick + length, len(place) - 1)] - 1 if compress else pick + length - 1)
            aligned = np.zeros(len(raw), np.int16)
            aligned[np.repeat(usable, lengths)] = marks[np.repeat(usable, n_marks)].astype(np.int16) - 33
            if len(pick):
                span = np.arange(int((last - first).max()) + 1)
                least_q = aligned[np.minimum(first[:, None] + span, last[:, None])].min(1)
            else:
                least_q = np.zeros(0, np.int16)
            cuts = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, v) for v in (pa.array(least[pick].astype(np.int64)), pa.array((pick - offsets[row]).astype(np.int32)), pa.array((forward[pick] >= backward[pick]).astype(np.int8)), pa.array(np.clip(least_q, -128, 127).astype(np.int8), mask=~usable[row]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(mean_q, mask=np.isnan(mean_q)), pa.array(lengths.astype(np.int32))], names=["read_id", "minimizers", "pos", "dir", "qual", "mean_q", "read_len"])

    return run


def minimizer_reads(reads: DataFrame, length: int = 15, density: float = 0.005, compress: bool = False, repetitive: list[int] | None = None, min_quality: float = 0.0) -> DataFrame:
    """Each read as its minimizers: ``read_id, minimizers, pos, dir, qual, mean_q, read_len``.

    A minimizer is a canonical word of ``length`` (at most 16) bases whose hash
    lies below ``density`` of the hash range; words with a letter other than A, C,
    G, T, and a read's first and last word, are never taken.  ``pos`` counts in
    the run-compressed read if ``compress`` is set.  ``repetitive`` minimizers are
    skipped.  Reads of mean quality below ``min_quality`` keep their row without
    minimizers.  Null and empty sequences have none; ``qual`` holds nulls and
    ``mean_q`` is null where there is no usable quality.  No shuffle is needed.
    """
    if not 1 <= length <= 16:
        raise ValueError("length must be between 1 and 16")
    rows = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("seq").cast("string").alias("seq"), F.col("qual").cast("string").alias("qual"))
    return rows.mapInArrow(_select(length, density, compress, np.array(sorted(repetitive or []), np.uint64), min_quality), MREADS)


def _kmer_values(length: int, canonical: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            letters, offsets = flat_letters(b.column(1))
            base = BASE[letters]
            forward, backward = packed_kmers(_CODE[base], length)
            n = len(forward)
            bad = np.append(0, np.cumsum(base > 3))
            inside = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= length
            at = np.flatnonzero(inside & (bad[length:] == bad[:n])) if n else np.zeros(0, np.int64)
            value = np.minimum(forward, backward)[at] if canonical else forward[at]
            cuts = pa.array(np.searchsorted(rows_of(offsets, at), np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.int64)))], names=["read_id", "words"])

    return run


def kmer_values(reads: DataFrame, length: int, canonical: bool = True) -> DataFrame:
    """``read_id, words``: all words of ``length`` (at most 31) bases as numbers, two bits a base.

    Words with a letter other than A, C, G, T are left out; ``canonical`` takes the
    smaller of a word and its reverse complement.
    """
    rows = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("seq").cast("string").alias("seq"))
    return rows.mapInArrow(_kmer_values(length, canonical), "read_id long, words array<bigint>")


def spelled(value, length: int):
    """The letters of a word's number (a column)."""
    return F.concat(*[F.substring(F.lit("ACTG"), F.shiftright(value, 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in reversed(range(length))])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = flat_letters(b.column(1))
        _, new, place = _compress(UPPER[raw], offsets)
        # After a read's runs comes its length; an empty read has neither.
        some = np.diff(offsets) > 0
        row = rows_of(offsets, place)
        values = np.insert((place - offsets[row]).astype(np.int32), new[1:][some], np.diff(offsets)[some])
        cuts = (new + np.append(0, np.cumsum(some))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], names=["read_id", "positions"])


def run_positions(reads: DataFrame) -> DataFrame:
    """``read_id, positions``: 0-based starts of the runs of equal letters, then the length; [] of an empty read."""
    rows = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("seq").cast("string").alias("seq"))
    return rows.mapInArrow(_starts, "read_id long, positions array<int>")


def _mean_quality(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    errors = 10.0 ** (-(np.arange(256) - 33) / 10.0)
    for b in batches:
        marks, offsets = flat_letters(b.column(1))
        n = np.diff(offsets)
        row = np.repeat(np.arange(b.num_rows), n)
        mean = np.bincount(row, errors[marks], minlength=b.num_rows) / np.maximum(n, 1)
        with np.errstate(divide="ignore"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-10 * np.log10(mean), mask=n == 0)], names=["read_id", "mean_q"])


def mean_qualities(reads: DataFrame) -> DataFrame:
    """``read_id, mean_q``: quality of the mean error; null for null or empty qual."""
    rows = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("qual").cast("string").alias("qual"))
    return rows.mapInArrow(_mean_quality, "read_id long, mean_q double")


def _complexity(window: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            letters, offsets = flat_letters(b.column(1))
            base = BASE[letters].astype(np.int64)
            n = max(0, len(base) - 2)
            word = base[:n] * 16 + base[1 : n + 1] * 4 + base[2 : n + 2] if n else np.zeros(0, np.int64)
            ok = (base[:n] < 4) & (base[1 : n + 1] < 4) & (base[2 : n + 2] < 4) if n else np.zeros(0, bool)
            ok &= np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= 3
            word, row = word[ok], rows_of(offsets, np.flatnonzero(ok))
            # Words of a read are numbered without the invalid ones; only full windows count.
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            windows = np.maximum(0, (np.diff(cuts) - window) // step + 1)
            owner = np.repeat(np.arange(b.num_rows), windows)
            start = cuts[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
            score = np.zeros(len(owner))
            for first in range(0, len(owner), 20_000):
                w = word[start[first : first + 20_000, None] + np.arange(window)] + 64 * np.arange(len(start[first : first + 20_000]))[:, None]
                c = np.bincount(w.ravel(), minlength=64 * len(w)).reshape(-1, 64)
                score[first : first + 20_000] = (c * (c - 1) // 2).sum(1) / (window - 3)
            total = np.bincount(owner, score, minlength=b.num_rows)
            most = np.zeros(b.num_rows)
            np.maximum.at(most, owner, score)
            none = windows == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total / np.maximum(windows, 1), mask=none), pa.array(most, mask=none)], names=["read_id", "mean_score", "max_score"])

    return run


def sequence_complexity(reads: DataFrame, window: int = 64, step: int = 32) -> DataFrame:
    """``read_id, mean_score, max_score`` of full windows of trinucleotides.

    A window's score is its pairs of equal words over ``window - 3``.  Words with a
    letter other than A, C, G, T are passed over; reads without a full window have
    null scores (and so pass any "too low" test).
    """
    rows = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("seq").cast("string").alias("seq"))
    return rows.mapInArrow(_complexity(window, step), "read_id long, mean_score double, max_score double")


def filtered(b: pa.RecordBatch, values: pa.ListArray, keep: np.ndarray) -> pa.RecordBatch:
    """The batch with the kept elements of its list columns, which are as long as ``values``."""
    base = values.offsets.to_numpy() - values.offsets[0].as_py()
    cuts = pa.array(np.append(0, np.cumsum(keep))[base].astype(np.int32))
    mask = pa.array(keep)
    out = [pa.ListArray.from_arrays(cuts, c.flatten().filter(mask)) if pa.types.is_list(c.type) else c for c in b.columns]
    return pa.RecordBatch.from_arrays(out, names=b.schema.names)


def lower_density(mreads: DataFrame, density: float) -> DataFrame:
    """Keep the minimizers that a lower density would have selected, all arrays aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = density_bound(density)
        for b in batches:
            values = b.column("minimizers")
            yield filtered(b, values, murmur64(values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float64) < bound)

    return mreads.mapInArrow(run, mreads.schema)


def minimizer_counts(mreads: DataFrame) -> DataFrame:
    """``minimizer, n``: occurrences over all reads."""
    return mreads.select(F.explode("minimizers").alias("minimizer")).groupBy("minimizer").agg(F.count("*").alias("n"))


#: Share of the distinct minimizers that counts as repetitive.
REPETITIVE = 1e-5
#: Different counts that are looked at from the top; so many distinct minimizers at least are more frequent than the rest.
FREQUENT = 1_000_000
#: Repetitive minimizers that are handed to every task (eight bytes each); beyond that they are joined.
HANDED = 2_000_000


def repetitive_minimizers(counts: DataFrame, fraction: float = REPETITIVE) -> DataFrame:
    """The most frequent ``fraction`` of distinct minimizers, at least one; ties by value.

    How many there are of each count is added up first, so that only those of the
    last count taken are put in order.
    """
    each = counts.groupBy("n").agg(F.count("*").alias("m"))
    sizes = [(r["n"], r["m"]) for r in each.orderBy(F.desc("n")).limit(FREQUENT).collect()]
    left = max(1, int(counts.count() * fraction))
    for n, m in sizes:
        if m > left:
            return counts.where(F.col("n") > n).unionByName(counts.where(F.col("n") == n).orderBy("minimizer").limit(left))
        left -= m
    # All counts fit, or there are more than FREQUENT different ones among them.
    return counts.where(F.col("n") >= sizes[-1][0]) if sizes else counts


def without_repetitive(mreads: DataFrame, repetitive: DataFrame, handed: int = HANDED) -> DataFrame:
    """Reads without their repetitive minimizers, in order, all arrays aligned.

    Up to ``handed`` values go to every task; more are joined with the reads' rows.
    Rows keep their row, with empty arrays where nothing is left.
    """
    lists = [f.name for f in mreads.schema if f.dataType.typeName() == "array"]
    values = repetitive.select("minimizer").limit(handed + 1).toPandas()["minimizer"].to_numpy(np.int64)
    if len(values) <= handed:
        banned = np.sort(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = b.column("minimizers")
                flat = m.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(banned, flat), max(len(banned) - 1, 0))
                yield filtered(b, m, np.ones(len(flat), bool) if not len(banned) else banned[at] != flat)

        return mreads.mapInArrow(run, mreads.schema)
    keyed = materialize(mreads.withColumn("_row", F.monotonically_increasing_id()))
    each = keyed.select("_row", F.posexplode(F.arrays_zip(*lists)).alias("_i", "_z"))
    kept = each.withColumn("minimizer", F.col("_z.minimizers")).join(repetitive.select("minimizer"), "minimizer", "left_anti")
    back = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_i", "_z"))).alias("_w"))
    types = {f.name: f.dataType for f in mreads.schema}
    joined = keyed.drop(*lists).join(back, "_row", "left")
    out = {c: F.coalesce(F.transform("_w", lambda x: x["_z"][c]), F.array()).cast(types[c]) for c in lists}  # noqa: B023
    return joined.withColumns(out).select(*mreads.columns)
