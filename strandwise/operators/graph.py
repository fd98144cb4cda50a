"""De Bruijn graphs over k-min-mers as two DataFrames: nodes and oriented edges.

A node is ``node long, minimizers array<bigint>, abundances array<bigint>``.  It
stands for itself and its reverse; an oriented edge is ``src, src_rev, dst,
dst_rev`` and always comes with its mirror.  Two oriented nodes are joined where
the last ``overlap`` minimizers of one are the first of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize, scoped, shuffle_width
from . import regions
from .skew import lookup_join


def numbered(counts: DataFrame) -> DataFrame:
    """k-min-mer counts as nodes with ids; written, so that ids are settled."""
    return materialize(counts.select(F.monotonically_increasing_id().alias("node"), F.col("km").alias("minimizers"), F.array(F.col("abundance").cast("long")).alias("abundances")))


def both_ways(nodes: DataFrame) -> DataFrame:
    """Each node in either orientation; a palindrome once."""
    ways = F.array(F.struct(F.lit(False).alias("rev"), F.col("minimizers").alias("path")), F.struct(F.lit(True).alias("rev"), F.reverse("minimizers").alias("path")))
    return nodes.select("node", F.explode(ways).alias("w")).select("node", "w.rev", "w.path").where(~F.col("rev") | (F.col("path") != F.reverse("path")))


def oriented_edges(nodes: DataFrame, overlap: int) -> DataFrame:
    """``src, src_rev, dst, dst_rev``; no edge from a node's end to its own reverse."""
    ways = both_ways(nodes)
    out = ways.select(F.col("node").alias("src"), F.col("rev").alias("src_rev"), F.slice("path", F.size("path") - (overlap - 1), overlap).alias("edge"))
    into = ways.select(F.col("node").alias("dst"), F.col("rev").alias("dst_rev"), F.slice("path", 1, overlap).alias("edge"))
    joined = out.join(into, "edge").where((F.col("src") != F.col("dst")) | (F.col("src_rev") == F.col("dst_rev")))
    return joined.select("src", "src_rev", "dst", "dst_rev")


def distinct_edges(counts: DataFrame, k: int) -> DataFrame:
    """The distinct normalised (k-1)-tuples at either side of the k-min-mers."""
    sides = F.array(F.slice("km", 1, k - 1), F.slice("km", 2, k - 1))
    return counts.select(F.explode(F.transform(sides, lambda e: F.least(e, F.reverse(e)))).alias("edge")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, rev, n_succ``: successors of every oriented node that has any."""
    return edges.groupBy(F.col("src").alias("node"), F.col("src_rev").alias("rev")).agg(F.count("*").alias("n_succ"))


def _code(node: str, rev: str) -> Column:
    return F.col(node) * 2 + F.col(rev).cast("long")


def unbranched(edges: DataFrame) -> DataFrame:
    """Links ``u, v`` between oriented nodes of one successor and one predecessor."""
    coded = edges.select(_code("src", "src_rev").alias("u"), _code("dst", "dst_rev").alias("v"))
    single_out = coded.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).where("n = 1").select("u", "v")
    single_in = coded.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    return single_out.join(single_in, "v", "left_semi").where("u <> v").select("u", "v")


#: Rows of a graph's skeleton (ids alone) that one task handles at a time.
PER_TASK = 1_000_000
RANKS = "c long, next long, n long, into long, off long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join every piece to its successor where the same task holds both; vectorised list ranking.

    Pieces that stay have null ``into``; those joined to another say to which, and
    how far from its start.  A cycle becomes one piece that is its own successor.
    """
    held = [[b.column(0).to_numpy(zero_copy_only=False), b.column(1).fill_null(-1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)] for b in batches if b.num_rows]
    if not held:
        return
    c, after, n = (np.concatenate(x).astype(np.int64) for x in zip(*held))
    by = np.argsort(c)
    c, after, n = c[by], after[by], n[by]
    m = len(c)
    at = np.minimum(np.searchsorted(c, after), m - 1)
    here = (after >= 0) & (c[at] == after) & (after != c)
    before = np.full(m, -1)
    before[at[here]] = np.flatnonzero(here)

    def ranked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up = np.where(before < 0, np.arange(m), before)
        off = np.where(before < 0, 0, n[up])
        least = np.minimum(np.arange(m), up)
        for _ in range(m.bit_length() + 1):
            off, least, up = off + off[up], np.minimum(least, least[up]), up[up]
        return up, off, least

    # Offsets on a cycle mean nothing (and wrap) until it is cut.
    with np.errstate(over="ignore"):
        up, off, least = ranked()
        ring = before[up] >= 0
        if ring.any():
            cut_ = np.flatnonzero(ring & (least == np.arange(m)))
            here[before[cut_]] = False
            before[cut_] = -1
            up, off, _ = ranked()
    last = np.flatnonzero(~here)
    gone = np.flatnonzero(before >= 0)
    none = pa.nulls(len(last), pa.int64())
    names = ["c", "next", "n", "into", "off"]
    yield pa.RecordBatch.from_arrays([pa.array(c[up[last]]), pa.array(after[last], mask=after[last] < 0), pa.array(off[last] + n[last]), none, none], names=names)
    none = pa.nulls(len(gone), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c[gone]), none, none, pa.array(c[up[gone]]), pa.array(off[gone])], names=names)


@scoped
def chain_places(chain: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Place of every element of linked lists ``c, next`` (null at an end): ``c, head, dist, circular``.

    Rounds of contraction: elements are dealt to tasks of ``per_task`` rows, each
    task joins what it holds, and only the joined pieces go on.  A coin thrown for
    each piece sends a successor that fell tails to the task of its predecessor
    that fell heads, so every round joins a quarter of the links at least, in
    expectation, and rows shrink geometrically; once one task holds all, one round
    is left.  The rounds are then undone, giving every element its place.  Cycles
    begin anywhere.
    """
    scratch = Scratch(chain.sparkSession)
    path, now, rows = scratch.counted(chain.select("c", "next", F.lit(1).cast("long").alias("n")))
    levels, round_ = [], 0
    open_ = F.col("next").isNotNull() & (F.col("next") != F.col("c"))
    while True:
        tasks = max(1, -(-rows // per_task))
        coin = lambda x: F.pmod(F.xxhash64(x, F.lit(round_)), F.lit(2))  # noqa: B023, E731
        route = F.when(open_ & (coin(F.col("c")) == 1) & (coin(F.col("next")) == 0), F.col("next")).otherwise(F.col("c"))
        joined = now.repartition(tasks, route).mapInArrow(_contract, RANKS)
        seen, alive = Observation(), F.col("into").isNull()
        _, table = scratch.write(joined.observe(seen, F.count_if(alive).alias("rows"), F.count_if(alive & open_).alias("links")))
        found = seen.get or {}
        levels.append(table.where(~alive))
        now, rows, round_ = table.where(alive).select("c", "next", "n"), found.get("rows") or 0, round_ + 1
        if not found.get("links"):
            break
    scratch.drop(path)
    placed = now.select("c", F.col("c").alias("head"), F.lit(0).cast("long").alias("dist"), F.coalesce(F.col("next") == F.col("c"), F.lit(False)).alias("circular"))
    for i, level in enumerate(reversed(levels)):
        known = placed.select(F.col("c").alias("into"), "head", F.col("dist").alias("base"), "circular")
        placed = placed.unionByName(level.join(known, "into").select("c", "head", (F.col("base") + F.col("off")).alias("dist"), "circular"))
        if i % 4 == 3:
            placed = scratch.keep(placed)
    return placed


def _ring(m: Column, a: Column, overlap: int) -> Column:
    """A cycle's arrays, cut where the minimizers on the better strand are the smallest array: a struct ``m, a``."""

    def ways(path: Column, weights: Column) -> Column:
        n = F.size(path) - overlap
        least = F.array_min(F.slice(path, F.lit(1), n))
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(path, i + 1) == least)
        turned = lambda x, i, size: F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.element_at(x, ((i + j) % n + 1).cast("int")))
        return F.transform(starts, lambda i: F.struct(turned(path, i, n + overlap).alias("m"), turned(weights, i, n).alias("a")))

    return F.array_min(F.concat(ways(m, a), ways(F.reverse(m), F.reverse(a))))


def _unitig_rows(scratch: Scratch, paths: DataFrame) -> DataFrame:
    return scratch.keep(paths.select(F.monotonically_increasing_id().alias("node"), "minimizers", "abundances", F.greatest(median(F.col("abundances")), F.lit(1.0)).alias("abundance"), "circular"))


@scoped
def compact(nodes: DataFrame, overlap: int, per_task: int = PER_TASK) -> DataFrame:
    """Merge all unbranched paths: ``node, minimizers, abundances, abundance, circular``.

    Both orientations of a path give one unitig, the one whose minimizers are the
    smaller array.  A cycle is opened where its minimizers are the smallest array.
    ``abundance`` is the median of the k-min-mers' abundances, 1 at least.  No nodes
    give no unitigs.  A node that was a ring stays one.

    ``nodes`` should be a written table, as it is read several times.  Paths are
    found by :func:`chain_places` over ids alone; arrays move only once,
    when each path is put together, which is as large as its unitig.
    """
    scratch = Scratch(nodes.sparkSession)
    ring = F.col("circular") if "circular" in nodes.columns else F.lit(False)
    nodes = nodes.select("node", "minimizers", "abundances", ring.alias("ring"))
    links = unbranched(oriented_edges(nodes, overlap))
    coded = both_ways(nodes).select(_code("node", "rev").alias("c"))
    placed = chain_places(coded.join(links.select(F.col("u").alias("c"), F.col("v").alias("next")), "c", "left"), per_task)
    parts = placed.withColumn("node", F.shiftright("c", 1)).withColumn("rev", F.col("c") % 2 == 1).join(nodes, "node")
    oriented = parts.select(
        "head", "dist", (F.col("circular") | F.col("ring")).alias("circular"), "circular", "ring",
        F.when(F.col("rev"), F.reverse("minimizers")).otherwise(F.col("minimizers")).alias("path"),
        F.when(F.col("rev"), F.reverse("abundances")).otherwise(F.col("abundances")).alias("abundances"),
    ).toDF("head", "dist", "closed", "circular", "ring", "path", "abundances")
    piece = F.struct("dist", F.when(F.col("dist") == 0, F.col("path")).otherwise(F.slice("path", overlap + 1, F.size("path"))).alias("p"), "abundances")
    walked = oriented.groupBy("head").agg(F.array_sort(F.collect_list(piece)).alias("w"), F.max("circular").alias("new_ring"), F.max("closed").alias("circular"))
    whole = walked.select("new_ring", "circular", F.flatten(F.transform("w", lambda x: x["p"])).alias("m"), F.flatten(F.transform("w", lambda x: x["abundances"])).alias("a"))
    # A path and its mirror: the smaller array stands for both.
    either = F.least(F.struct("m", "a"), F.struct(F.reverse("m").alias("m"), F.reverse("a").alias("a")))
    best = whole.select("circular", F.when(F.col("new_ring"), _ring(F.col("m"), F.col("a"), overlap)).otherwise(either).alias("x"))
    return _unitig_rows(scratch, best.select(F.col("x.m").alias("minimizers"), F.col("x.a").alias("abundances"), "circular").distinct())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task replaced by one from each of its vertices to the smallest it is connected with."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        least = np.minimum(p, q)
        if (p == q).all():
            break
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    some = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], names=["a", "b"])


#: Edges (two ids) that one task reduces to stars at a time.
EDGES_PER_TASK = 4_000_000


@scoped
def components(edges: DataFrame, rows: int, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Smallest vertex connected with each: ``vertex, root``; a vertex that is its own root has no row.

    ``edges``: ``a, b``, ``rows`` of them.  Every task first reduces its edges to
    stars.  If there is more than one task, large-star and small-star rounds join the
    stars of different tasks until every vertex hangs on its root; hubs take the
    balanced join.
    """
    scratch = Scratch(edges.sparkSession)
    now, n = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), rows
    while True:
        tasks = max(1, -(-n // per_task))
        _, now, n = scratch.counted(now.repartition(tasks, "a").mapInArrow(_stars, "a long, b long"))
        if tasks == 1 or not n:
            break
        both = scratch.keep(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = scratch.keep(lookup_join(both.where("b > a"), "a", least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = scratch.keep(lookup_join(large, "a", least, "a"))
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        _, now, n = scratch.counted(small)
        # Stars: no root hangs on another vertex, and every vertex on one root.
        if now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and now.select("a").distinct().count() == n:
            break
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def node_components(nodes: DataFrame, overlap: int, rows: int, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``nodes``, ``rows`` of them, with ``region``: equal for nodes that are connected, however far.

    Nodes with a common end are connected; ends are known by a hash, and should two
    ends share one, the components are merely kept together.
    """
    ends = F.array(F.slice("minimizers", 1, overlap), F.slice("minimizers", F.size("minimizers") - (overlap - 1), overlap))
    vertex = F.col("node") * 2
    pairs = nodes.select(vertex.alias("a"), F.explode(F.transform(ends, lambda e: F.shiftleft(F.xxhash64(F.least(e, F.reverse(e))), 1).bitwiseOR(F.lit(1)))).alias("b"))
    # Only the smallest vertex of a component matters as its name.
    labels = components(pairs, 2 * rows, per_task).where(F.col("vertex") % 2 == 0).select(F.shiftright("vertex", 1).alias("node"), F.col("root").alias("region"))
    return nodes.join(labels, "node", "left").withColumn("region", F.coalesce("region", vertex))


STATES = "kind string, cutoff double, minimizers array<bigint>, abundances array<bigint>, abundance double, circular boolean"


def _by_region(work: Callable[[list], list]):
    """Hand each region's nodes to ``work``; rows come sorted by region."""

    def emit(rows: list) -> pa.RecordBatch:
        kind, cutoff, unitigs = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        m, a, c = (list(x) for x in zip(*unitigs)) if unitigs else ([], [], [])
        lists = [pa.array([list(x) for x in v], pa.list_(pa.int64())) for v in (m, a)]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(cutoff, pa.float64()), *lists, pa.array([regions.abundance_of(u) for u in unitigs], pa.float64()), pa.array(c, pa.bool_())], names=["kind", "cutoff", "minimizers", "abundances", "abundance", "circular"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, out = [], None, []
        for b in batches:
            for region, m, a, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if region != current and held:
                    out += work(held)
                    held = []
                    if len(out) > 2000:
                        yield emit(out)
                        out = []
                current = region
                held.append((tuple(m), tuple(a), bool(c)))
        if held:
            out += work(held)
        yield emit(out)

    return run


def _states(overlap: int, longest: int, first: float, kinds: tuple[str, ...]):
    def work(nodes: list) -> list:
        shots = regions.snapshots(nodes, overlap, longest, first)
        out = []
        for kind in kinds:
            if kind == "graph":
                out += [("graph", 0.0, u) for u in shots[0][1]]
            elif kind == "state":
                out += [("state", t, u) for t, unitigs in shots for u in unitigs]
            else:
                out += [("contig", t, u) for t, u in regions.chosen(shots, overlap + 1)]
        return out

    return work


#: Nodes of a component that one task simplifies; larger ones take rounds over the whole table.
REGION = 2_000_000


@scoped
def states(nodes: DataFrame, overlap: int, longest: int, first: float = regions.FIRST_CUTOFF, kinds: tuple[str, ...] = ("state",), region: int = REGION, per_task: int = PER_TASK) -> DataFrame:
    """What becomes of a graph as its weakest nodes go: ``kind, cutoff, minimizers, abundances, abundance, circular``.

    ``graph``: the simplified unitigs; ``state``: all unitigs of every state, with the
    cutoff at which it came about; ``contig``: those chosen (see :func:`select_contigs`).
    States are those of a component, whose cutoffs depend on no other component.
    ``nodes`` should be a written table, as it is read several times.

    Components are kept whole and dealt to tasks, as nothing links them; one of more
    than ``region`` nodes is simplified by rounds of joins instead.  That bound is
    on a task's memory; the rounds follow the same rules.
    """
    scratch = Scratch(nodes.sparkSession)
    ring = F.col("circular") if "circular" in nodes.columns else F.lit(False)
    bare = nodes.select("node", "minimizers", "abundances", ring.alias("circular"))
    rows = nodes.count()
    marked = scratch.keep(node_components(bare, overlap, rows, per_task))
    # At most one in ``region`` nodes; none where there aren't as many nodes.
    large = [r[0] for r in marked.groupBy("region").count().where(F.col("count") > region).select("region").collect()] if rows > region else []
    near = marked.where(~F.col("region").isin(large)) if large else marked
    width = shuffle_width(nodes.sparkSession, rows, region)
    near = near.select("region", "minimizers", "abundances", "circular").repartition(width, "region").sortWithinPartitions("region").mapInArrow(_by_region(_states(overlap, longest, first, kinds)), STATES)
    for name in large:
        near = near.unionByName(_far_states(marked.where(F.col("region") == name).drop("region"), overlap, longest, first, kinds))
    return near


GROWN = "kind string, k int, cutoff double, minimizers array<bigint>, abundances array<bigint>, abundance double, circular boolean"


def _grown(first_k: int, last_k: int, longest: Callable[[int], int]):
    """:func:`regions.grown` of each region; rows ``region, minimizers, abundance`` come sorted by region, stretches of reads with null ``abundance``."""

    def emit(rows: list) -> pa.RecordBatch:
        kind, k, cutoff, unitigs = zip(*rows) if rows else ((), (), (), ())
        m, a, c = zip(*((u[0], u[1], u[2]) for u in unitigs)) if rows else ((), (), ())
        lists = [pa.array(v, pa.list_(pa.int64())) for v in (m, a)]
        weights = [float(u[1][0]) if name == "solid" else regions.abundance_of(u) for name, u in zip(kind, unitigs)]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(k, pa.int32()), pa.array(cutoff, pa.float64()), *lists, pa.array(weights, pa.float64()), pa.array(c, pa.bool_())], names=["kind", "k", "cutoff", "minimizers", "abundances", "abundance", "circular"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solid, pieces, same, current, out = {}, [], {}, None, []
        for b in batches:
            for region, m, a in zip(*(b.column(i).to_pylist() for i in range(3))):
                if region != current:
                    if solid:
                        out += regions.grown(solid, pieces, first_k, last_k, longest)
                    solid, pieces, same, current = {}, [], {}, region
                    if len(out) > 2000:
                        yield emit(out)
                        out = []
                m = tuple([same.setdefault(x, x) for x in m])
                if a is None:
                    pieces.append(m)
                else:
                    solid[m] = a
        if solid:
            out += regions.grown(solid, pieces, first_k, last_k, longest)
        yield emit(out)

    return run


def grown(rows: DataFrame, n: int, first_k: int, last_k: int, longest: Callable[[int], int], region: int = REGION) -> DataFrame:
    """The passes of growing k, component by component (:func:`regions.grown`): ``kind, k, cutoff, minimizers, abundances, abundance, circular``.

    ``rows``, ``n`` of them: ``region, minimizers, abundance``, the solid k-min-mers of the
    first k and, with null ``abundance``, the stretches of reads made of them.
    """
    width = shuffle_width(rows.sparkSession, n, region)
    return rows.select("region", "minimizers", "abundance").repartition(width, "region").sortWithinPartitions("region").mapInArrow(_grown(first_k, last_k, longest), GROWN)


def _far_states(nodes: DataFrame, overlap: int, longest: int, first: float, kinds: tuple[str, ...]) -> DataFrame:
    """:func:`states` of one component too large for a task."""
    scratch = Scratch(nodes.sparkSession)
    shots = scratch.keep(_progressive(nodes, overlap, longest, first))
    columns = ["cutoff", "minimizers", "abundances", "abundance", "circular"]
    parts = {"graph": lambda: shots.where("cutoff = 0"), "state": lambda: shots, "contig": lambda: select_contigs(shots, overlap + 1)}
    return reduce(DataFrame.unionByName, [parts[kind]().select(F.lit(kind).alias("kind"), *columns) for kind in kinds])


def median(a: Column) -> Column:
    """Median of an array of numbers; the mean of the middle pair of an even count."""
    s = F.array_sort(a)
    n = F.size(a)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(s, F.floor(n / 2 + 1).cast("int"))
    return (low + high) / 2.0


def tips(nodes: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """Nodes to clip in one round: ``node``.

    A tip has at most ``longest`` minimizers, nothing beyond one end, and hangs on
    a node that keeps another successor.  Where all successors of a node are tips,
    the longest (then most abundant, then the one of the smallest array) stays.
    """
    ends = both_ways(nodes).select("node", "rev").join(degrees(edges), ["node", "rev"], "left").where("n_succ is null").select("node", "rev")
    short = nodes.select("node", "minimizers", F.size("minimizers").alias("n_min"), F.greatest(median(F.col("abundances")), F.lit(1.0)).alias("abundance")).where(F.col("n_min") <= longest)
    candidates = ends.join(short, "node")
    hung = edges.join(candidates.select(F.col("node").alias("dst"), F.col("rev").alias("dst_rev"), "minimizers", "n_min", "abundance"), ["dst", "dst_rev"], "left")
    at = Window.partitionBy("src", "src_rev")
    best = at.orderBy(F.col("n_min").isNotNull(), F.desc("n_min"), F.desc("abundance"), F.least("minimizers", F.reverse("minimizers")), "dst_rev")
    ranked = hung.withColumn("r", F.row_number().over(best)).withColumn("n", F.count("*").over(at))
    return ranked.where("n > 1 and r > 1 and n_min is not null").select(F.col("dst").alias("node")).distinct()


def simple_bubbles(nodes: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """Sides to remove: ``node``.  All but the most abundant of the unbranched nodes between the same two ends."""
    d = degrees(edges)
    one = d.where("n_succ = 1").select("node", "rev")
    # One successor each way.
    inner = one.join(one.select("node", (~F.col("rev")).alias("rev")), ["node", "rev"], "left_semi")
    short = nodes.select("node", "minimizers", F.size("minimizers").alias("n_min"), median(F.col("abundances")).alias("abundance")).where(F.col("n_min") <= longest)
    into = edges.select(F.col("src").alias("s"), F.col("src_rev").alias("s_rev"), F.col("dst").alias("node"), F.col("dst_rev").alias("rev"))
    out = edges.select(F.col("src").alias("node"), F.col("src_rev").alias("rev"), F.col("dst").alias("t"), F.col("dst_rev").alias("t_rev"))
    sides = into.join(inner, ["node", "rev"], "left_semi").join(out, ["node", "rev"]).join(short, "node")
    # A bubble and its mirror are seen from either end; one view decides.
    forward = sides.where((F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("s_rev") <= F.col("t_rev"))))
    rank = Window.partitionBy("s", "s_rev", "t", "t_rev").orderBy(F.desc("abundance"), F.desc("n_min"), F.least("minimizers", F.reverse("minimizers")))
    return forward.withColumn("r", F.row_number().over(rank)).where("r > 1").select("node").distinct()


@scoped
def superbubbles(nodes: DataFrame, edges: DataFrame, overlap: int, longest: int) -> DataFrame:
    """Superbubbles, each from both its sides: ``source, exit, inner`` (codes ``2 node + rev``).

    The rules are those of :func:`regions.superbubble`.  All sources advance at once:
    a round visits, for each source, the nodes all of whose predecessors it has
    visited; sources at which a rule fails are dropped, and ways are bounded by
    ``longest``, so the rounds are too.
    """
    scratch = Scratch(nodes.sparkSession)
    palindrome = F.col("minimizers") == F.reverse("minimizers")
    code = _code("node", "rev")
    out = edges.select(_code("src", "src_rev").alias("v"), _code("dst", "dst_rev").alias("w"))
    n_out, n_in = out.groupBy("v").agg(F.count("*").alias("n_out")), out.groupBy("w").agg(F.count("*").alias("n_in"))
    sized = nodes.select("node", F.size("minimizers").alias("size"), palindrome.alias("same"))
    ways = both_ways(nodes).select("node", "rev").join(sized, "node").select(code.alias("w"), "size", F.when(F.col("same"), code).otherwise(F.col("node") * 2 + 1 - F.col("rev").cast("long")).alias("flip")).join(n_in, "w", "left")
    steps = scratch.keep(out.join(n_out, "v").where(F.col("n_out") <= regions.MANY).join(ways, "w"))
    ready = scratch.keep(steps.where("n_out > 1").select(F.col("v").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(0).alias("far")))
    spark = nodes.sparkSession
    visited, waiting = spark.createDataFrame([], "s long, v long"), spark.createDataFrame([], "s long, w long, seen long, far int")
    found = []
    while not ready.isEmpty():
        visited = scratch.keep(visited.unionByName(ready.select("s", "v")))
        taken = scratch.keep(ready.join(steps, "v", "left").select("s", "v", "far", "w", "size"))
        dead = taken.where(F.col("w").isNull() | (F.col("w") == F.col("s")) | ((F.col("far") > longest) & (F.col("v") != F.col("s")))).select("s")
        new = taken.where("w is not null").select("s", "w", F.lit(1).cast("long").alias("seen"), (F.col("far") + F.col("size") - overlap).alias("far"))
        seen = scratch.keep(waiting.unionByName(new).groupBy("s", "w").agg(F.sum("seen").alias("seen"), F.max("far").cast("int").alias("far")).join(ways.select("w", "flip", F.coalesce("n_in", F.lit(0)).alias("n_in")), "w"))
        dead = dead.unionByName(seen.join(visited.withColumnRenamed("v", "w"), ["s", "w"], "left_semi").select("s"))
        flipped = seen.where("flip <> w").select("s", F.col("flip").alias("v"))
        dead = dead.unionByName(flipped.join(visited.unionByName(seen.select("s", F.col("w").alias("v"))), ["s", "v"], "left_semi").select("s")).distinct()
        alive = scratch.keep(seen.join(dead, "s", "left_anti"))
        last = alive.groupBy("s").agg(F.count("*").alias("n"), F.max("w").alias("exit"), F.min(F.col("seen") == F.col("n_in")).alias("whole")).where("n = 1 and whole").select("s", "exit")
        closing = scratch.keep(last.join(out.select(F.col("v").alias("exit"), F.col("w").alias("s")), ["s", "exit"], "left_anti").where(F.shiftright("exit", 1) != F.shiftright("s", 1)))
        inner = visited.where("v <> s").join(closing, "s").groupBy("s", "exit").agg(F.collect_list("v").alias("inner"))
        found.append(inner.select(F.col("s").alias("source"), "exit", "inner"))
        going = scratch.keep(alive.join(last, "s", "left_anti"))
        ready = scratch.keep(going.where("seen = n_in").select("s", F.col("w").alias("v"), "far"))
        waiting = going.where("seen <> n_in").select("s", "w", "seen", "far")
        # What leads nowhere any more is dropped with all it has visited.
        visited = visited.join(ready.select("s").distinct(), "s", "left_semi")
        waiting = waiting.join(ready.select("s").distinct(), "s", "left_semi")
    if not found:
        return spark.createDataFrame([], "source long, exit long, inner array<bigint>")
    return reduce(DataFrame.unionByName, found)


def _lost(longest: int, overlap: int):
    """Nodes that collapsing a bubble removes; a row holds one bubble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rev, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = regions.Region([(tuple(x["minimizers"]), tuple(x["abundances"]), False) for x in parts], overlap)
                at = next(i for i, x in enumerate(parts) if x["role"] == 0)
                found = regions.superbubble(g, 2 * at + int(rev), longest)
                if found:
                    kept = {c >> 1 for c in regions.heaviest(g, 2 * at + int(rev), *found)}
                    out += [parts[i]["node"] for i in {c >> 1 for c in found[1]} - kept]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    return run


@scoped
def lost_sides(nodes: DataFrame, edges: DataFrame, overlap: int, longest: int) -> DataFrame:
    """Nodes that collapsing a round's superbubbles removes: ``node``.

    Bubbles are taken smaller ones first, none touching another's inside; of each the
    heaviest way is kept (:func:`regions.heaviest`).
    """
    scratch = Scratch(nodes.sparkSession)
    found = scratch.keep(superbubbles(nodes, edges, overlap, longest))
    parts = F.concat(F.array(F.struct(F.col("source").alias("c"), F.lit(0).alias("role")), F.struct(F.col("exit").alias("c"), F.lit(1).alias("role"))), F.transform("inner", lambda c: F.struct(c.alias("c"), F.lit(2).alias("role"))))
    rows = found.select("source", "exit", F.explode(parts).alias("p")).select("source", "exit", F.shiftright("p.c", 1).alias("node"), (F.col("p.c") % 2 == 1).alias("rev"), "p.role").join(nodes.select("node", "minimizers", "abundances"), "node")
    gathered = rows.groupBy("source", "exit").agg(F.collect_list(F.struct("node", "rev", "role", "minimizers", "abundances")).alias("parts"))
    read = lambda x: F.when(x["rev"], F.reverse(x["minimizers"])).otherwise(x["minimizers"])
    other = lambda x: F.when(x["rev"], x["minimizers"]).otherwise(F.reverse(x["minimizers"]))
    of = lambda role: F.filter("parts", lambda x: x["role"] == role)
    source, exit_ = of(0)[0], of(1)[0]
    content = F.array_sort(F.transform(of(2), lambda x: F.least(x["minimizers"], F.reverse(x["minimizers"]))))
    ends = F.least(F.struct(read(source).alias("a"), read(exit_).alias("b")), F.struct(other(exit_).alias("a"), other(source).alias("b")))
    keyed = gathered.select("source", "exit", "parts", F.struct(F.size(content).alias("n"), content.alias("content"), ends.alias("ends")).alias("key"), read(source).alias("reads"))
    view = Window.partitionBy("key").orderBy("reads", "source")
    left = scratch.keep(keyed.withColumn("_r", F.row_number().over(view)).where("_r = 1").drop("_r", "reads"))
    taken = []
    while not left.isEmpty():
        # Those that come first at every node they share with others; then all that touch these go.
        at = scratch.keep(left.select("key", F.explode(F.transform("parts", lambda x: F.struct(x["node"].alias("node"), (x["role"] == 2).alias("inside")))).alias("p")).select("key", "p.node", "p.inside"))
        mine, others = at.select("node", F.col("key").alias("k"), F.col("inside").alias("i")), at
        meets = others.join(mine, "node").where((F.col("inside") | F.col("i")) & (F.col("k") < F.col("key"))).select("key", "k").distinct()
        first = scratch.keep(left.join(meets.select("key").distinct(), "key", "left_anti"))
        taken.append(first)
        barred = meets.join(first.select(F.col("key").alias("k")), "k", "left_semi").select("key").distinct()
        left = scratch.keep(left.join(barred, "key", "left_anti").join(first.select("key"), "key", "left_anti"))
    if not taken:
        return nodes.limit(0).select("node")
    bubbles = reduce(DataFrame.unionByName, taken)
    return bubbles.select(source["rev"].alias("rev"), "parts").mapInArrow(_lost(longest, overlap), "node long").distinct()


def without(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    return nodes.join(removed.select("node"), "node", "left_anti")


@scoped
def simplify(nodes: DataFrame, overlap: int, longest: int, per_task: int = PER_TASK) -> DataFrame:
    """Remove bubbles, then tips, compacting after each, until nothing changes."""
    scratch = Scratch(nodes.sparkSession)
    nodes = compact(nodes, overlap, per_task)
    while True:
        changed = False
        for find in (partial(lost_sides, overlap=overlap), tips):
            gone = scratch.keep(find(nodes, scratch.keep(oriented_edges(nodes, overlap)), longest=longest))
            if not gone.isEmpty():
                nodes, changed = compact(scratch.keep(without(nodes, gone)), overlap, per_task), True
        if not changed:
            return nodes


def lasting(unitigs: DataFrame, overlap: int) -> DataFrame:
    """Without unitigs that touch no other and were seen just once."""
    once = unitigs.where(F.col("abundance") == 1)
    touching = oriented_edges(unitigs, overlap).where("src <> dst").select(F.col("src").alias("node")).distinct()
    return unitigs.where(F.col("abundance") != 1).unionByName(once.join(touching, "node", "left_semi"))


def _progressive(nodes: DataFrame, overlap: int, longest: int, first: float) -> DataFrame:
    """States of a graph as its weakest nodes go, by rounds over the whole table; a threshold that removes nothing is skipped."""
    scratch = Scratch(nodes.sparkSession)
    now = simplify(nodes, overlap, longest)
    shots, t = [lasting(now, overlap).withColumn("cutoff", F.lit(0.0))], first
    weakest, most = now.agg(F.min("abundance"), F.max("abundance")).first()
    while weakest is not None and t <= min(most, regions.LIMIT):
        if weakest < t:
            now = simplify(scratch.keep(now.where(F.col("abundance") >= t)), overlap, longest)
            weakest = now.agg(F.min("abundance")).first()[0]
            shots.append(lasting(now, overlap).withColumn("cutoff", F.lit(t)))
        t = regions.after(t)
    return reduce(DataFrame.unionByName, shots)


def progressive(nodes: DataFrame, overlap: int, longest: int, first: float = regions.FIRST_CUTOFF, region: int = REGION) -> DataFrame:
    """Snapshots of the graph as its weakest nodes go: all unitigs of each state, with ``cutoff``.

    The first snapshot (``cutoff`` 0) is the simplified graph.  A component has a
    snapshot at each threshold that removes some of its nodes.
    """
    return states(nodes, overlap, longest, first, ("state",), region).drop("kind")


@scoped
def select_contigs(snapshots: DataFrame, k: int) -> DataFrame:
    """Contigs from the strictest snapshot down: unitigs whose abundance is twice the cutoff or more.

    A unitig is taken at the highest cutoff at which it qualifies, unless one of its
    k-min-mers belongs to a contig taken at a higher cutoff (of one cutoff: of the
    smaller array); one that isn't taken bars no other.  Each round takes those that
    are the strictest left for all their k-min-mers and drops what shares any with
    them, which gives the contigs of going down level by level in fewer rounds.
    """
    scratch = Scratch(snapshots.sparkSession)
    fit = snapshots.where(F.col("abundance") >= F.col("cutoff") / 0.5)
    columns = [c for c in ("cutoff", "minimizers", "abundances", "abundance", "circular") if c in fit.columns]
    ident = scratch.keep(ordered_ids(fit.select(*columns), ["minimizers", "cutoff"], "contig"))
    parts = ident.select("contig", "cutoff", F.explode(F.transform(F.sequence(F.lit(1), F.size("minimizers") - (k - 1)), lambda i: F.slice("minimizers", i, k))).alias("raw")).select("contig", "cutoff", F.least("raw", F.reverse("raw")).alias("km")).distinct()
    path, left, n = scratch.counted(parts)
    taken = []
    while n:
        best = left.groupBy("km").agg(F.min(F.struct((-F.col("cutoff")).alias("strict"), "contig")).alias("b")).select("km", F.col("b.contig").alias("owner"))
        behind = left.join(best, "km").where("owner <> contig").select("contig").distinct()
        first = scratch.keep(left.join(behind, "contig", "left_anti").select("contig", "km"))
        taken.append(first.select("contig").distinct())
        gone = left.join(first.select("km"), "km", "left_semi").select("contig").distinct()
        rest, left, n = scratch.counted(left.join(gone, "contig", "left_anti"))
        scratch.drop(path)
        path = rest
    if not taken:
        return ident
    return ident.join(reduce(DataFrame.unionByName, taken), "contig", "left_semi")


@scoped
def neighbourhood(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` edges of ``sources`` (column ``node``): ``node, dist``."""
    scratch = Scratch(edges.sparkSession)
    links = scratch.keep(edges.select("src", "dst").distinct())
    reached = frontier = scratch.keep(sources.select("node").distinct().withColumn("dist", F.lit(0)))
    for d in range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("dist", F.lit(d))
        _, frontier, n = scratch.counted(step)
        if not n:
            break
        reached = scratch.keep(reached.unionByName(frontier))
    return reached


def rings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are rings or follow themselves: ``node, circular, follows_itself``."""
    loops = edges.where(F.col("src") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.max(F.col("src_rev") == F.col("dst_rev")).alias("follows_itself"))
    told = nodes.select("node", "circular").join(loops, "node", "left")
    return told.where(F.col("circular") | F.col("follows_itself").isNotNull()).select("node", "circular", F.coalesce("follows_itself", F.lit(False)).alias("follows_itself"))


def end_edges(nodes: DataFrame, overlap: int) -> DataFrame:
    """The distinct normalised ends of ``overlap`` minimizers: ``edge``."""
    ends = F.array(F.slice("minimizers", 1, overlap), F.slice("minimizers", F.size("minimizers") - (overlap - 1), overlap))
    return nodes.select(F.explode(F.transform(ends, lambda e: F.least(e, F.reverse(e)))).alias("edge")).distinct()


def unitig_name(number: Column) -> Column:
    return F.concat(F.lit("utg"), number.cast("string"))


def unitig_number(name: Column) -> Column:
    """The number in a unitig's name; null for any other text."""
    digits = F.regexp_extract(name, r"^utg(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def oriented(number: Column, rev: Column) -> Column:
    """One number for a unitig and its strand; its lowest bit is the strand."""
    return F.shiftleft(number, 1).bitwiseOR(rev.cast("long"))


@scoped
def abundant_neighbourhood(nodes: DataFrame, edges: DataFrame, sources: DataFrame, longest: int, overlap: int, least: float = 2.0, share: float = 0.5) -> DataFrame:
    """Nodes around ``sources`` (column ``node``) that may belong to the same sequence: ``node, source, dist``.

    A node is reached over nodes of more than ``least`` abundance and at least
    ``share`` of the source's, along no more than ``longest`` minimizers.  Rounds of
    joins; a node goes on only from its shortest distance.
    """
    scratch = Scratch(edges.sparkSession)
    links = scratch.keep(edges.select("src", "dst").distinct())
    weight = nodes.select("node", F.col("abundance").alias("w"), (F.size("minimizers") - overlap).alias("size"))
    start = sources.select("node").distinct().join(weight, "node").select("node", F.col("node").alias("source"), F.lit(0).alias("dist"), F.col("w").alias("own"))
    reached = frontier = scratch.keep(start)
    while not frontier.isEmpty():
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "source", "dist", "own").join(weight, "node")
        fit = step.where((F.col("w") > least) & (F.col("w") >= share * F.col("own"))).select("node", "source", (F.col("dist") + F.col("size")).alias("dist"), "own").where(F.col("dist") <= longest)
        best = fit.groupBy("node", "source").agg(F.min("dist").alias("dist"), F.first("own").alias("own"))
        known = reached.select("node", "source", F.col("dist").alias("before"))
        frontier = scratch.keep(best.join(known, ["node", "source"], "left").where("before is null or dist < before").drop("before"))
        reached = scratch.keep(reached.unionByName(frontier).groupBy("node", "source").agg(F.min("dist").alias("dist"), F.first("own").alias("own")))
    return reached.select("node", "source", "dist")


def supported(nodes: DataFrame, solid: DataFrame, k: int) -> DataFrame:
    """Nodes all of whose ``k``-min-mers are solid."""
    parts = nodes.where(F.size("minimizers") >= k).select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size("minimizers") - (k - 1)), lambda i: F.slice("minimizers", i, k))).alias("raw")).select("node", F.least("raw", F.reverse("raw")).alias("km"))
    return without(nodes, parts.join(solid.select("km"), "km", "left_anti").select("node").distinct())


def ordered_ids(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order``, which should be total.

    Rows are range-partitioned and sorted; each is numbered within its partition and
    moved by what the partitions before hold, one number a partition.  No task sees
    more than its own range.
    """
    scratch = Scratch(rows.sparkSession)
    parted = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*order)
    numbered_ = parted.withColumn("_r", F.row_number().over(within) - 1)
    return numbered_.join(before, "_p").select((F.col("_before") + F.col("_r")).cast("long").alias(name), *rows.columns)
