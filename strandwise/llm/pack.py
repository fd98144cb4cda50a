"""Filling containers of several permitted lengths: best fit over the histogram of sizes.

Items of one size are interchangeable, so the plan needs only how many items
have each size: at most ``capacity`` numbers, whatever the corpus.  The plan is
made from them on the driver and names kinds of containers and how many there
are of each; the rows then find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, shuffle_width

#: Items ranked by one task.
ITEMS_PER_LANE = 100_000
CONTAINERS = "container_id long, capacity int, used int, doc_id long, piece int, piece_start int, n_tokens int"


def _best_fit(room: int, first: int, sizes: list[int], left: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Contents of one container of ``room`` that begins with an item of size ``first``.

    The next item is always the one that leaves least space: the largest that fits.
    Returns the space that nothing left fits into, and ``(size, items)``.
    """
    contents, size = [], first
    while True:
        n = min(room // size, left[size])
        contents.append((size, n))
        room -= n * size
        k = bisect_right(sizes, min(room, size - 1)) - 1
        if k < 0:
            return room, contents
        size = sizes[k]


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Kinds of containers ``(capacity, number, [(size, items), ...])``.

    Variable-capacity best fit.  The largest item left opens a container.  Which
    permitted capacity is opened is decided by cost: each that holds the item is
    filled, best fit, from what is left, and the one with the smallest unused share
    is opened (of equal ones the largest).  So a small capacity is chosen where a
    large one couldn't be filled, and no capacity is preferred beforehand.  The same
    contents are repeated as often as the items left allow, so equal containers are
    handled by number.  At the end each container is downsized to the least
    permitted capacity that holds its contents.
    """
    limits = sorted(set(capacities))
    if any(s < 1 or s > limits[-1] for s in histogram):
        raise ValueError("sizes must be between 1 and the largest capacity")
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        first = sizes[-1]
        filled = ((c, *_best_fit(c, first, sizes, left)) for c in limits[bisect_left(limits, first) :])
        capacity, unused, contents = min(filled, key=lambda x: (x[1] / x[0], -x[0]))
        number = min(left[s] // n for s, n in contents)
        out.append((limits[bisect_left(limits, capacity - unused)], number, contents))
        for s, n in contents:
            left[s] -= n * number
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))
    return out


def _table(kinds: list[tuple[int, int, list[tuple[int, int]]]], top: int) -> dict[str, np.ndarray]:
    """For each size, ranges of ranks and the containers they fill, ordered by size and rank."""
    entries, taken, base = [], {}, 0
    for capacity, number, contents in kinds:
        used = sum(s * n for s, n in contents)
        for size, each in contents:
            start = taken.get(size, 0)
            entries.append((size, start, base, each, capacity, used))
            taken[size] = start + each * number
        base += number
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 6).T
    return dict(zip(("size", "start", "base", "each", "capacity", "used"), columns)) | {"edge": np.searchsorted(columns[0], np.arange(top + 2))}


def _place(t: dict[str, np.ndarray]):
    # Size and rank as one increasing number: a rank has 40 bits, so a size may have a million million items.
    key = (t["size"] << 40) + t["start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            at = np.searchsorted(key, (size << 40) + rank, "right") - 1
            container = t["base"][at] + (rank - t["start"][at]) // t["each"][at]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(t["capacity"][at].astype(np.int32)), pa.array(t["used"][at].astype(np.int32)), b.column(0), b.column(1), b.column(2), b.column(3)], names=["container_id", "capacity", "used", "doc_id", "piece", "piece_start", "n_tokens"])

    return run


def packed(sizes: DataFrame, capacity: int = 2048, capacities: list[int] | None = None, items_per_lane: int = ITEMS_PER_LANE) -> DataFrame:
    """Assign items ``doc_id, n_tokens`` to containers.

    Columns ``container_id, capacity, used, doc_id, piece, piece_start,
    n_tokens``: the container, its permitted length after downsizing, the tokens
    in it, and the part of the item it holds.  ``capacities`` are the permitted
    lengths (all at most ``capacity``; default ``capacity`` alone).  An item of
    more than ``capacity`` tokens is cut into full containers and a rest, piece
    after piece; no other item is cut.  Items of null or 0 size aren't assigned.
    Repeated ids are items of their own.  An empty table gives no rows.

    Only the histogram reaches the driver, at most ``capacity`` numbers.  Full
    pieces are a container each and need no rank.  The others are ranked within
    their size in as many lanes as their number asks for, so a size that a third of
    all items have isn't ranked in one task.  Container numbers are unique, not
    consecutive.
    """
    spark = sizes.sparkSession
    limits = sorted({capacity, *(capacities or [])})
    if limits[-1] > capacity:
        raise ValueError("permitted lengths must not exceed the capacity")
    n = F.col("n_tokens").cast("int")
    starts = F.sequence(F.lit(0), n - 1, F.lit(capacity))
    cuts = sizes.where("n_tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens"), F.posexplode(starts).alias("piece", "piece_start"))
    items = Scratch(spark).keep(cuts.select("doc_id", "piece", "piece_start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_start")).cast("int").alias("n_tokens")))
    part = items.where(F.col("n_tokens") < capacity)
    histogram = {r[0]: r[1] for r in part.groupBy("n_tokens").count().collect()}
    kinds = plan(histogram, limits)
    planned = sum(number for _, number, _ in kinds)
    # Rows of a written table keep their place, so these numbers are the same at every run.
    full = items.where(F.col("n_tokens") == capacity).select((F.monotonically_increasing_id() + planned).alias("container_id"), F.lit(capacity).alias("capacity"), F.lit(capacity).alias("used"), "doc_id", "piece", "piece_start", "n_tokens")
    if not histogram:
        return full
    lanes = shuffle_width(spark, sum(histogram.values()), items_per_lane)
    placed = part.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("n_tokens", "lane").count().select("n_tokens", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "lane").orderBy("doc_id", "piece")
    ranked = placed.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "lane"])
    ready = ranked.select("doc_id", "piece", "piece_start", "n_tokens", (F.col("r") + F.col("offset")).cast("long").alias("rank"))
    return ready.mapInArrow(_place(_table(kinds, capacity)), CONTAINERS).unionByName(full)


def fill_report(containers: DataFrame) -> DataFrame:
    """One row: containers, tokens, room and the share of unused space."""
    each = containers.select("container_id", "capacity", "used").distinct()
    return each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("room")).select("*", (1 - F.col("tokens") / F.col("room")).alias("unused"))
