"""Long exact spans shared between records, found over every window of letters.

Every window of consecutive letters is compared with every other, by content.
To keep the shuffle near the size of the text, neighbouring windows travel
together: a window belongs to the bucket of its minimizer (the least hash among
its short words), so a stretch of windows with one minimizer is sent once, at
two bits a letter.  Equal windows have equal minimizers and meet in one bucket,
where windows are grouped by their full content, not by a hash alone.

A first pass counts windows per bucket, exactly: each batch sends the counts of
the buckets it has, and they are added up in ranges of buckets.  Windows of
overfull buckets (adapters, repeats) are routed one by one by their content
instead, after each batch has reduced equal windows to one representative, so
neither a frequent minimizer nor a frequent window makes a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flat import BASE, flat_letters, rows_of
from ..session import shuffle_width

#: Letters of the words among which a window's minimizer is chosen.
WORD = 21
#: Letters handled at a time; bounds a task's memory for reads of any length.
SLICE = 3_000_000
PIECE = "bucket int, payload binary"
STRETCH = "read_id long, start int, stop int, later boolean"
#: Ranges of buckets in which the census is added up, at least; each holds SPAN buckets at most.
RANGES, SPAN = 256, 4_000_000
#: Overfull buckets known to every task, at most: the fullest.  Any other has at most a HOT_BOUND-th of all windows.
HOT_BOUND = 1 << 22
#: One bucket's count in one batch.
COUNT = np.dtype([("at", "<u4"), ("n", "<u4")])
#: A piece of the payload: read, first window, windows, flag, then the letters.
HEAD = np.dtype([("read", "<i8"), ("start", "<i4"), ("n", "<u2"), ("flag", "u1"), ("pad", "u1")])


def _words(codes: np.ndarray, length: int) -> np.ndarray:
    """Each position's next ``length`` letters (up to 32) packed at two bits; the last ones are cut off."""
    have, packed = 0, None
    power, width = codes.astype(np.uint64), 1
    rest = length
    while rest:
        if rest & 1:
            if packed is None:
                packed, have = power, width
            else:
                n = len(codes) - have - width + 1
                packed, have = (packed[:n] << np.uint64(2 * width)) | power[have : have + n], have + width
        rest >>= 1
        if rest:
            n = len(power) - width
            power, width = (power[:n] << np.uint64(2 * width)) | power[width : width + n], 2 * width
    return packed


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class _Windows:
    """The valid windows of some reads: positions and minimizer hashes."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, window: int):
        n = len(codes) - window + 1
        bad = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(codes > 3, out=bad[1:])
        valid = bad[window:] == bad[: n if n > 0 else 0] if n > 0 else np.zeros(0, bool)
        if n > 0:
            left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
            valid &= left >= window
        self.at = np.flatnonzero(valid)
        word = min(WORD, window)
        if len(self.at):
            ranks = (_scatter(_words(codes & 3, word)) >> np.uint64(32)).astype(np.uint32)
            self.least = _window_min(ranks, window - word + 1)[self.at]
        else:
            self.least = np.zeros(0, np.uint32)

    def buckets(self, n: int) -> np.ndarray:
        # The least of many hashes is small, so it is scattered anew.
        x = self.least * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        return ((x.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, base numbers and offsets of whole reads, about SLICE letters at a time."""
    letters, offsets = flat_letters(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield ids[first:last], BASE[letters[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        first = last


def _census(window: int, buckets: int, span: int):
    """Windows of each bucket in each slice: one row a range of ``span`` buckets, with the counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes, offsets in _slices(b):
                found = _Windows(codes, offsets, window).buckets(buckets)
                if not len(found):
                    continue
                # Neighbouring windows mostly share their bucket: stretches are sorted, not windows.
                edge = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                n, found = np.diff(np.append(edge, len(found))), found[edge]
                by = np.argsort(found, kind="stable")
                found, n = found[by], n[by]
                edge = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                n, found = np.add.reduceat(n, edge), found[edge]
                where = found // span
                counts = np.zeros(len(found), COUNT)
                counts["at"], counts["n"] = found - where * span, n
                cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                rows = [counts[x:z].tobytes() for x, z in zip(cuts, np.append(cuts[1:], len(where)))]
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    return run


def _tally(span: int, most: int):
    """Buckets of more than ``most`` windows, one range after the other: ``bucket, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(span, np.int64)
        current = None

        def full() -> pa.RecordBatch:
            at = np.flatnonzero(total > most)
            return pa.RecordBatch.from_arrays([pa.array((at + current * span).astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

        for b in batches:
            for where, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if where != current:
                    if current is not None:
                        yield full()
                    total[:] = 0
                    current = where
                counts = np.frombuffer(payload.as_buffer(), COUNT)
                total[counts["at"]] += counts["n"]
        if current is not None:
            yield full()

    return run


def _pack(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of ragged stretches, each padded to whole bytes of four letters; and the byte counts."""
    size = (length + 3) // 4
    total = int(size.sum())
    begin = np.cumsum(size) - size
    at = np.repeat(first - 4 * begin, size) + 4 * np.arange(total)
    last = len(codes) - 1
    out = np.zeros(total, np.uint8)
    for k in range(4):
        out = (out << 2) | (codes[np.minimum(at + k, last)] & 3)
    return out, size


class _Contents:
    """The windows that begin at given places, comparable by their whole content.

    A window is held as words of up to 32 letters, the last of which may overlap the
    one before; the words of a place are looked up when they are needed, so a long
    window costs no more memory than a short one.
    """

    def __init__(self, letters: np.ndarray, window: int):
        width = min(32, window)
        self.words = _words(letters, width)
        self.steps = [*range(0, window - width, width), window - width]

    def hashed(self, at: np.ndarray) -> np.ndarray:
        x = self.words[at + self.steps[0]]
        for s in self.steps[1:]:
            x = _scatter(x) ^ (self.words[at + s] * np.uint64(0xFF51AFD7ED558CCD))
        return _scatter(x)

    def group(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers ordered by content, and where each content begins."""
        mixed = self.hashed(at)
        by = np.argsort(mixed, kind="stable")
        new = np.ones(len(by), bool)
        if len(by) > 1:
            m, place = mixed[by], at[by]
            alike = m[1:] == m[:-1]
            same = alike.copy()
            for s in self.steps:
                x = self.words[place + s]
                same &= x[1:] == x[:-1]
            if np.any(alike & ~same):
                # Different windows of one hash: order by the content itself.
                by = np.lexsort([self.words[at + s] for s in self.steps])
                same = np.ones(len(by) - 1, bool)
                for s in self.steps:
                    x = self.words[at[by] + s]
                    same &= x[1:] == x[:-1]
            new[1:] = ~same
        return by, np.flatnonzero(new)


def _send(window: int, buckets: int, hot: np.ndarray, lanes: int):
    """Stretches of windows with one bucket; of hot buckets single windows, one of each content."""
    hot = np.sort(hot)

    def overfull(bucket: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(bucket), bool)
        at = np.searchsorted(hot, bucket)
        return hot[np.minimum(at, len(hot) - 1)] == bucket

    def pieces(bucket: np.ndarray, head: np.ndarray, codes: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """One row a bucket: how many pieces, their heads, then their letters."""
        by = np.argsort(bucket, kind="stable")
        bucket, head, first = bucket[by], head[by], first[by]
        letters, size = _pack(codes, first, head["n"].astype(np.int64) + window - 1)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        stop = np.append(edges[1:], len(bucket))
        byte = np.append(0, np.cumsum(size))
        rows = [np.int64(b - a).tobytes() + head[a:b].tobytes() + letters[byte[a] : byte[b]].tobytes() for a, b in zip(edges, stop)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, offsets in _slices(b):
                w = _Windows(codes, offsets, window)
                if not len(w.at):
                    continue
                bucket = w.buckets(buckets)
                row = rows_of(offsets, w.at)
                plain = ~overfull(bucket)
                at, own, bk = w.at[plain], row[plain], bucket[plain]
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = (bk[1:] != bk[:-1]) | (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
                    edge = np.flatnonzero(new)
                    n = np.diff(np.append(edge, len(at)))
                    head = np.zeros(len(edge), HEAD)
                    head["read"], head["start"], head["n"] = ids[own[edge]], at[edge] - offsets[own[edge]], n
                    long = n > 60_000  # the count has 16 bits; a stretch of one bucket is far shorter but for low-complexity runs
                    if long.any():
                        parts = np.where(long, -(-n // 60_000), 1)
                        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        head = np.repeat(head, parts)
                        head["start"] += (k * 60_000).astype(np.int32)
                        head["n"] = np.minimum(np.repeat(n, parts) - k * 60_000, 60_000)
                        first = np.repeat(at[edge], parts) + k * 60_000
                        yield pieces(np.repeat(bk[edge], parts), head, codes, first)
                    else:
                        yield pieces(bk[edge], head, codes, at[edge])
                at, own = w.at[~plain], row[~plain]
                if len(at):
                    contents = _Contents(codes & 3, window)
                    by, edge = contents.group(at)
                    read = ids[own[by]]
                    low, high = np.minimum.reduceat(read, edge), np.maximum.reduceat(read, edge)
                    size = np.diff(np.append(edge, len(by)))
                    # Windows that only one read of the batch has all go on; of others one read speaks for all.
                    here = np.repeat(low != high, size)
                    first = np.repeat(low, size)
                    go = ~here | (read == first)
                    send = by[go]
                    head = np.zeros(len(send), HEAD)
                    head["read"], head["start"], head["n"], head["flag"] = read[go], at[send] - offsets[own[send]], 1, here[go]
                    lane = (contents.hashed(at[send]) >> np.uint64(33)).astype(np.int64) % lanes
                    yield pieces((buckets + lane).astype(np.int32), head, codes, at[send])
                    # The others are settled: shared, and an earlier read has them.
                    done = by[~go]
                    if len(done):
                        done = done[np.argsort(at[done], kind="stable")]
                        head = np.zeros(len(done), HEAD)
                        head["read"], head["start"], head["n"] = ids[own[done]], at[done] - offsets[own[done]], 1
                        rest = buckets + lanes + (np.arange(len(done)) // 4096) % lanes
                        cuts = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
                        rows = [head[a:z].tobytes() for a, z in zip(cuts, np.append(cuts[1:], len(done)))]
                        yield pa.RecordBatch.from_arrays([pa.array(rest[cuts].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    return run


def _unpack(payload: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, letters, and each piece's first letter."""
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    head = np.frombuffer(payload, HEAD, n, 8)
    packed = np.frombuffer(payload, np.uint8, -1, 8 + n * HEAD.itemsize)
    letters = np.empty((len(packed), 4), np.uint8)
    for k in range(4):
        letters[:, k] = (packed >> (6 - 2 * k)) & 3
    size = (head["n"].astype(np.int64) + window - 1 + 3) // 4
    return head, letters.ravel(), 4 * (np.cumsum(size) - size)


def _meet(window: int, settled: int):
    """Group the windows of one bucket by content; give the stretches that other reads have too."""

    def stretches(read: np.ndarray, start: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(read), bool)
        new[1:] = (read[1:] != read[:-1]) | (start[1:] != start[:-1] + 1) | (later[1:] != later[:-1])
        edge = np.flatnonzero(new)
        n = np.diff(np.append(edge, len(read)))
        return pa.RecordBatch.from_arrays([pa.array(read[edge]), pa.array(start[edge].astype(np.int32)), pa.array((start[edge] + n - 1 + window).astype(np.int32)), pa.array(later[edge])], names=["read_id", "start", "stop", "later"])

    def meet(payloads: list[bytes]) -> pa.RecordBatch | None:
        texts, places, reads, starts, flags, before = [], [], [], [], [], 0
        for p in payloads:
            head, letters, first = _unpack(p, window)
            n = head["n"].astype(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            texts.append(letters)
            places.append(np.repeat(first, n) + step + before)
            before += len(letters)
            reads.append(np.repeat(head["read"], n))
            starts.append(np.repeat(head["start"], n) + step)
            flags.append(np.repeat(head["flag"], n) > 0)
        read, start, flag = np.concatenate(reads), np.concatenate(starts), np.concatenate(flags)
        by, edge = _Contents(np.concatenate(texts), window).group(np.concatenate(places))
        size = np.diff(np.append(edge, len(by)))
        many = np.flatnonzero(size > 1)
        alone = by[edge[size == 1]]
        out = [alone[flag[alone]]]
        later = np.zeros(len(read), bool)
        if len(many):
            pick = np.repeat(edge[many] - (np.cumsum(size[many]) - size[many]), size[many]) + np.arange(size[many].sum())
            member = by[pick]
            begin = np.cumsum(size[many]) - size[many]
            r = read[member]
            low, high = np.minimum.reduceat(r, begin), np.maximum.reduceat(r, begin)
            shared = (low != high) | np.maximum.reduceat(flag[member].astype(np.uint8), begin).astype(bool)
            later[member] = r != np.repeat(low, size[many])
            out.append(member[np.repeat(shared, size[many])])
        hit = np.sort(np.concatenate(out))
        return stretches(read[hit], start[hit], later[hit]) if len(hit) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket >= settled:
                    head = np.frombuffer(payload, HEAD)
                    yield stretches(head["read"], head["start"].astype(np.int64), np.ones(len(head), bool))
                    continue
                if bucket != current and held:
                    found = meet(held)
                    held = []
                    if found is not None:
                        yield found
                current = bucket
                held.append(payload)
        if held and (found := meet(held)) is not None:
            yield found

    return run


def shared_stretches(reads: DataFrame, window: int = 60, id_col: str = "read_id", seq: str = "seq", windows_per_bucket: int = 250_000, buckets_per_task: int = 4, hot_bound: int = HOT_BOUND) -> DataFrame:
    """Stretches of windows that stand in another read too: ``read_id, start, stop, later``.

    ``later`` marks stretches whose every window a read of smaller id has as
    well (a repeated span that isn't the first).  Stretches of one read may
    overlap; see :func:`covered_spans`.

    ``window`` is 2 letters or more.  Case is ignored; a window holding a letter
    other than A, C, G, T isn't compared.  Reads with null id, or with null, empty
    or too short sequences have no rows.  Rows of one id count as one read.

    Tasks hold a bucket's windows, a range's counts, and the list of overfull
    buckets, which has ``hot_bound`` entries at most; nothing else grows with the
    reads.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    spark = reads.sparkSession
    rows = reads.select(F.col(id_col).cast("long").alias("read_id"), F.col(seq).cast("string").alias("seq")).where(F.col("read_id").isNotNull() & (F.length("seq") >= window))
    letters = rows.agg(F.sum(F.length("seq"))).first()[0] or 0
    buckets = shuffle_width(spark, letters, windows_per_bucket)
    span = min(SPAN, -(-buckets // RANGES))
    ranges = -(-buckets // span)
    counts = rows.mapInArrow(_census(window, buckets, span), PIECE).repartition(shuffle_width(spark, ranges, RANGES), "bucket").sortWithinPartitions("bucket")
    overfull = counts.mapInArrow(_tally(span, 4 * windows_per_bucket), "bucket int, n long")
    hot = np.array([r[0] for r in overfull.orderBy(F.desc("n"), "bucket").limit(hot_bound).collect()], np.int32)
    width = shuffle_width(spark, buckets, buckets_per_task)
    sent = rows.mapInArrow(_send(window, buckets, hot, buckets), PIECE)
    return sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(window, 2 * buckets), STRETCH)


def covered_spans(stretches: DataFrame) -> DataFrame:
    """Stretches of a read that overlap or adjoin, as one: ``read_id, span_start, span_len``."""
    by_start = Window.partitionBy("read_id").orderBy("start", "stop")
    reach = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.select("read_id", "start", "stop", (reach.isNull() | (F.col("start") > reach)).cast("int").alias("new"))
    numbered = marked.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("read_id", "island").agg(F.min("start").alias("span_start"), F.max("stop").alias("stop"))
    return spans.select("read_id", "span_start", (F.col("stop") - F.col("span_start")).alias("span_len"))


def shared_letters(reads: DataFrame, stretches: DataFrame, id_col: str = "read_id", seq: str = "seq") -> DataFrame:
    """Each read's letters, letters shared with other reads, and letters to remove.

    ``n_repeated`` counts letters in repeated spans of which a read of smaller id
    holds the first occurrence: removing these leaves one copy of every span.
    Every read has a row; without shared spans the counts are 0.
    """
    per_read = covered_spans(stretches).groupBy("read_id").agg(F.sum("span_len").alias("n_shared"))
    later = covered_spans(stretches.where("later")).groupBy("read_id").agg(F.sum("span_len").alias("n_repeated"))
    base = reads.select(F.col(id_col).cast("long").alias("read_id"), F.coalesce(F.length(seq), F.lit(0)).cast("long").alias("n_letters"))
    joined = base.join(per_read, "read_id", "left").join(later, "read_id", "left")
    return joined.select("read_id", "n_letters", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))


def without_repeated(reads: DataFrame, stretches: DataFrame, id_col: str = "read_id", seq: str = "seq") -> DataFrame:
    """Reads without the letters covered by any non-first repeated span: ``read_id, seq, n_removed``.

    Every row keeps its row; where nothing is removed ``seq`` stays as it is, null
    included.  What stands before, between and after removed spans is joined.
    """
    later = covered_spans(stretches.where("later")).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_len"))).alias("gone"))
    base = reads.select(F.col(id_col).cast("long").alias("read_id"), F.col(seq).cast("string").alias("seq"))
    joined = base.join(later, "read_id", "left")
    # Kept pieces: from each removed span's end to the next one's start.
    edges = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["span_start"] + g["span_len"]))
    starts = F.concat(F.transform("gone", lambda g: g["span_start"]), F.array(F.length("seq")))
    kept = F.zip_with(edges, starts, lambda a, z: F.substring(F.col("seq"), a + 1, z - a))
    size = F.aggregate("gone", F.lit(0), lambda n, g: n + g["span_len"])
    return joined.select("read_id", F.when(F.col("gone").isNull(), F.col("seq")).otherwise(F.array_join(kept, "")).alias("seq"), F.coalesce(size, F.lit(0)).alias("n_removed"))
