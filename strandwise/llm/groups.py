"""Groups of records linked directly or through others: Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import Scratch

#: Index of a read that isn't set (the largest unsigned 32-bit number).
UNSET = 4294967295


def links(tables: list[tuple[DataFrame, str, str]], unset: int = UNSET) -> DataFrame:
    """Distinct links ``a <= b`` of several tables; rows with a null or unset end are no links."""
    parts = [t.select(F.least(x, y).cast("long").alias("a"), F.greatest(x, y).cast("long").alias("b")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != unset) & (F.col(y) != unset)) for t, x, y in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def _collapse(scratch: Scratch, nearest: DataFrame, nodes: int) -> DataFrame:
    """Each component's root, by pointer doubling over ``(node, up)``.

    ``up`` is the smallest neighbour.  The smallest edge of a component is the one
    to its smallest neighbour, whichever end it is seen from, so the hooks hold no
    cycle but pairs that chose each other; the smaller of a pair becomes the root.
    A row is done when its ``up`` is a root; only the others are looked up again.
    """

    def above(trees: DataFrame) -> DataFrame:
        return trees.select(F.col("node").alias("up"), F.col("up").alias("upper"), *([F.col("done").alias("there")] if "done" in trees.columns else []))

    step = lookup_join(nearest, "up", above(nearest), "up", rows=nodes)
    pair = F.col("upper") == F.col("node")
    # Of a pair the smaller is the root: it is done, and so is the larger that hangs on it.
    path, trees, left = scratch.counted(step.select("node", F.when(pair, F.least("node", "up")).otherwise(F.col("up")).alias("up"), pair.alias("done")), ~F.col("done"))
    while left:
        moved = lookup_join(trees.where("not done"), "up", above(trees), "up", rows=left).select("node", F.col("upper").alias("up"), F.col("there").alias("done"))
        new_path, trees, left = scratch.counted(trees.where("done").unionByName(moved), ~F.col("done"))
        scratch.drop(path)
        path = new_path
    return trees.select("node", "up")


def connected_groups(every: DataFrame) -> DataFrame:
    """Group of each record named in the distinct links ``a, b``: ``node, group_id``.

    ``group_id`` is the smallest record of the group.  A record linked only with
    itself is a group of its own.  Links with a null end are dropped.  An empty
    table gives no rows.

    A round lets every component hook onto its smallest neighbour, collapses the
    trees by pointer doubling, relabels the edges and drops duplicates and inner
    edges.  Components at least halve, so the rounds are logarithmic.  All tables
    stay distributed and are written between steps; hot records (a hub linked with
    a large share of all) take the balanced path of :func:`lookup_join`, whatever
    the number of links.
    """
    spark = every.sparkSession
    scratch = Scratch(spark)
    every = scratch.keep(every.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null"))
    edges, path = every.where("a <> b"), None
    n_edges = edges.count()
    rounds: list[tuple[DataFrame, int]] = []
    while n_edges:
        # Both directions, reduced to one row a node and task before the shuffle.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("up")))).alias("e")).select("e.*")
        nearest_path, nearest, nodes = scratch.counted(ends.groupBy("node").agg(F.min("up").alias("up")))
        roots = _collapse(scratch, nearest, nodes)
        scratch.drop(nearest_path)
        rounds.append((roots, nodes))
        half_path, half = scratch.write(lookup_join(edges, "a", roots.withColumnRenamed("up", "ra"), "node", rows=n_edges).select("ra", "b"))
        both = lookup_join(half, "b", roots.withColumnRenamed("up", "rb"), "node", rows=n_edges)
        new_path, edges, n_edges = scratch.counted(both.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        for old in (path, half_path):
            if old:
                scratch.drop(old)
        path = new_path
    if not rounds:
        labels, nodes = spark.createDataFrame([], "node long, up long"), 0
    else:
        # The last round's roots are final; each earlier round looks its roots up there.
        labels, nodes = rounds[-1]
        for earlier, nodes in reversed(rounds[:-1]):
            joined = lookup_join(earlier, "up", labels.withColumnRenamed("up", "final"), "node", how="left", rows=nodes)
            labels = scratch.keep(joined.select("node", F.coalesce("final", "up").alias("up")))
    smallest = labels.groupBy("up").agg(F.min("node").alias("group_id"))
    named = lookup_join(labels, "up", smallest, "up", rows=nodes).select("node", "group_id")
    alone = every.where("a = b").select(F.col("a").alias("node")).join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("group_id"))
    return named.unionByName(alone)
