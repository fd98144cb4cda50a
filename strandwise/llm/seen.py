"""Has this key been seen before? Blocked Bloom filters over hash-partitioned keys.

Every record is answered in order of its id: *seen* if its key occurred among
the known keys or in a record with a smaller id.  A task holds one filter of a
fixed size, never the keys; more keys mean more partitions, not larger filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

#: A block is one cache line: eight words of 64 bits, in each of which a key sets one bit.
WORDS, WORD_BITS = 8, 64
UNDECIDED, SEEN, KNOWN = 0, 1, 2
ANSWERS = "rec_id long, seen boolean, probes long, false_hits long, inserted long, filter_bytes long"


def expected_fpp(keys_per_block: float) -> float:
    """Chance that an absent key hits, with Poisson many keys in its block."""
    return sum(exp(j * log(keys_per_block) - keys_per_block - lgamma(j + 1)) * (1 - (1 - 1 / WORD_BITS) ** j) ** WORDS for j in range(1, 400))


@lru_cache(maxsize=64)
def load_for(target_fpp: float) -> float:
    """Keys a block may hold on average for ``target_fpp``."""
    low, high = 1e-3, 300.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected_fpp(mid) <= target_fpp else (low, mid)
    return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BlockedBloom:
    """Blocked Bloom filters for any number of keys at one error rate.

    A filter is opened for ``capacity`` keys; when it is full another one
    follows, with half the allowance, so the rate holds however many keys come.
    """

    def __init__(self, capacity: int, target_fpp: float):
        self.capacity, self.target = max(1, capacity), target_fpp
        self.filters: list[np.ndarray] = []
        self.room = 0
        self.inserted = 0

    def _open(self) -> None:
        allowance = self.target / 2 ** (len(self.filters) + 1)
        blocks = int(self.capacity / load_for(allowance)) + 1
        self.filters.append(np.zeros(blocks * WORDS, np.uint64))
        self.room = self.capacity

    @staticmethod
    def _places(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        first = _mix(hi + np.uint64(0x9E3779B97F4A7C15) * _mix(lo + np.uint64(0x632BE59BD9B4E019)))
        second = _mix(first ^ lo)
        bits = [np.uint64(1) << ((second >> np.uint64(6 * w)) & np.uint64(63)) for w in range(WORDS)]
        return first >> np.uint64(32), bits

    def query(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        block, bits = self._places(hi, lo)
        found = np.zeros(len(hi), bool)
        for words in self.filters:
            at = ((block * np.uint64(len(words) // WORDS)) >> np.uint64(32)).astype(np.int64) * WORDS
            hit = np.ones(len(hi), bool)
            for w in range(WORDS):
                hit &= (words[at + w] & bits[w]) != 0
            found |= hit
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        while len(hi):
            if not self.room:
                self._open()
            n = min(self.room, len(hi))
            block, bits = self._places(hi[:n], lo[:n])
            words = self.filters[-1]
            at = ((block * np.uint64(len(words) // WORDS)) >> np.uint64(32)).astype(np.int64) * WORDS
            for w in range(WORDS):
                np.bitwise_or.at(words, at + w, bits[w])
            self.room -= n
            self.inserted += n
            hi, lo = hi[n:], lo[n:]

    @property
    def bytes(self) -> int:
        return sum(f.nbytes for f in self.filters)


def _first_of_key(hi: np.ndarray, lo: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers sorted by key and order, and each one's first order within its key."""
    by = np.lexsort((order, lo, hi))
    h, l = hi[by], lo[by]
    new = np.ones(len(by), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    return by, np.repeat(order[by][new], np.diff(np.append(np.flatnonzero(new), len(by)))) if len(by) else order


def _once_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known keys, each once a batch, so that a key that is given often costs one row a batch."""
    for b in batches:
        hi, lo = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (1, 2))
        by, first = _first_of_key(hi, lo, np.arange(len(hi)))
        yield b.take(pa.array(by[by == first]))


def _settle_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: all but a batch's first record of a key are seen already.

    However many rows one key holds, only one a batch keeps its key and goes to the
    key's partition; the settled ones travel without a key and are spread evenly.
    """
    for b in batches:
        hi, lo = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (1, 2))
        rec = b.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
        by, first = _first_of_key(hi, lo, rec)
        state = np.empty(len(by), np.int8)
        state[by] = np.where(rec[by] > first, SEEN, UNDECIDED)
        keyless = state == SEEN
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hi, mask=keyless), pa.array(lo, mask=keyless), pa.array(state)], names=["rec_id", "hi", "lo", "state"])


def _answer(capacity: int, target_fpp: float, n_probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(capacity, target_fpp)
        made = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (2, n_probes), dtype=np.uint64)
        absent = np.ones(n_probes, bool)
        by_hi = np.argsort(made[0])
        sorted_hi = made[0][by_hi]

        def note(hi: np.ndarray) -> None:
            # A probe whose first half occurs as a key isn't surely absent and is dropped.
            at = np.searchsorted(sorted_hi, hi)
            at[at == n_probes] = 0
            absent[by_hi[at[sorted_hi[at] == hi]]] = False

        def settle(rec: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
            """Query, then insert; records of one id don't see each other."""
            seen = bloom.query(hi, lo)
            by, first = _first_of_key(hi, lo, rec)
            again = np.empty(len(by), bool)
            again[by] = rec[by] > first
            seen |= again
            fresh = ~seen
            bloom.insert(hi[fresh], lo[fresh])
            note(hi)
            return seen

        def out(rec: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(rec), pa.int64())
            last = np.iinfo(np.int64).max
            return pa.RecordBatch.from_arrays([pa.array(rec, mask=rec == last), pa.array(seen), none, none, none, none], names=["rec_id", "seen", "probes", "false_hits", "inserted", "filter_bytes"])

        carry: tuple[np.ndarray, ...] | None = None
        for b in batches:
            rec = b.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
            state = b.column(3).to_numpy(zero_copy_only=False)
            hi, lo = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (1, 2))
            known = state == KNOWN
            if known.any():
                # Keys that are in already, by this or another row, take no room.
                h, l = hi[known], lo[known]
                by, first = _first_of_key(h, l, np.arange(len(h)))
                h, l = h[by[by == first]], l[by[by == first]]
                fresh = ~bloom.query(h, l)
                bloom.insert(h[fresh], l[fresh])
                note(h)
            decided = state == SEEN
            if decided.any():
                yield out(rec[decided], np.ones(int(decided.sum()), bool))
            ask = state == UNDECIDED
            now = (rec[ask], hi[ask], lo[ask])
            if carry is not None:
                now = tuple(np.concatenate(x) for x in zip(carry, now))
            # Records that share the last id wait for the next batch, which may hold more of them.
            wait = now[0] == now[0][-1] if len(now[0]) else np.zeros(0, bool)
            carry = tuple(x[wait] for x in now)
            go = tuple(x[~wait] for x in now)
            if len(go[0]):
                yield out(go[0], settle(*go))
        if carry is not None and len(carry[0]):
            yield out(carry[0], settle(*carry))
        tried = made[:, absent]
        wrong = int(bloom.query(tried[0], tried[1]).sum()) if tried.shape[1] else 0
        row = [pa.array([None], pa.int64()), pa.array([None], pa.bool_()), *(pa.array([v], pa.int64()) for v in (tried.shape[1], wrong, bloom.inserted, bloom.bytes))]
        yield pa.RecordBatch.from_arrays(row, names=["rec_id", "seen", "probes", "false_hits", "inserted", "filter_bytes"])

    return run


def seen_before(
    records: DataFrame,
    known: DataFrame,
    id_col: str = "rec_id",
    key: tuple[str, str] = ("vec_hash_hi", "vec_hash_lo"),
    target_fpp: float = 1e-6,
    keys_per_filter: int = 1 << 19,
    probes: int | None = None,
) -> DataFrame:
    """Answer each record of ``records``, and measure the filters' error rate.

    Rows with ``rec_id`` hold an answer: ``seen``.  One row a partition has no
    answer but the filter's figures: ``probes`` keys proven absent from the
    partition, ``false_hits`` among them, keys ``inserted``, ``filter_bytes``.
    By default all partitions together try ``3 / target_fpp`` absent keys, so that
    no false hit among them bounds the rate by the target with 95 % confidence.

    Partitions follow from the records and the known keys together, so that each
    holds about one filter's worth of keys; a task's memory is that filter, the
    probes and a batch.

    Answers are never wrongly *not seen*; wrongly *seen* with a chance of at most
    ``target_fpp``.  Records with a null half of the key have no key and no row in
    the answers.  A null id counts as the largest.  Records of one id and key
    don't make each other seen.  Empty tables give no answers.
    Extra columns of either table are ignored.
    """
    hi, lo = key
    spark = records.sparkSession
    rows = records.select(F.col(id_col).cast("long").alias("rec_id"), F.col(hi).cast("long").alias("hi"), F.col(lo).cast("long").alias("lo")).where("hi is not null and lo is not null")
    asked = rows.mapInArrow(_settle_in_batch, "rec_id long, hi long, lo long, state tinyint")
    given = known.select(F.lit(None).cast("long").alias("rec_id"), F.col(hi).cast("long").alias("hi"), F.col(lo).cast("long").alias("lo"), F.lit(KNOWN).cast("tinyint").alias("state")).where("hi is not null and lo is not null")
    given = given.mapInArrow(_once_in_batch, "rec_id long, hi long, lo long, state tinyint")
    n = shuffle_width(spark, records.count() + known.count(), keys_per_filter)
    tried = max(1024, -(-int(3 / target_fpp) // n)) if probes is None else probes
    route = F.when(F.col("state") == SEEN, F.xxhash64("rec_id")).otherwise(F.xxhash64("hi", "lo"))
    placed = asked.unionByName(given).repartition(n, route)
    ordered = placed.sortWithinPartitions((F.col("state") == KNOWN).desc(), F.col("rec_id").asc_nulls_last())
    return ordered.mapInArrow(_answer(keys_per_filter, target_fpp, tried), ANSWERS)


def seen_ids(answers: DataFrame) -> DataFrame:
    """Ids of the records that were answered *seen*."""
    return answers.where("seen").select("rec_id")


def error_rate(answers: DataFrame, target_fpp: float = 1e-6) -> DataFrame:
    """One row: records answered, and the rate of wrong answers to absent keys.

    ``upper_95`` bounds the rate with 95 % confidence (the rule of three where no
    probe was answered wrongly, else the normal bound).
    """
    p = F.col("false_hits") / F.col("probes")
    upper = F.when(F.col("false_hits") == 0, 3.0 / F.col("probes")).otherwise(p + 1.645 * F.sqrt(p * (1 - p) / F.col("probes")))
    sums = answers.agg(
        F.count("seen").alias("records"),
        F.count_if("seen").alias("seen"),
        F.sum("inserted").alias("keys_inserted"),
        F.sum("probes").alias("probes"),
        F.sum("false_hits").alias("false_hits"),
        F.max("filter_bytes").alias("largest_filter_bytes"),
    )
    return sums.select("*", p.alias("measured_fpp"), upper.alias("upper_95"), F.lit(target_fpp).alias("target_fpp"))
