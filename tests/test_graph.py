import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import graph, intervals, regions, skew
from strandwise.plans import assembly

NODES = "node long, minimizers array<long>, abundances array<long>"


def nodes(spark, paths, k):
    seen = {}
    for p, n in paths:
        for i in range(len(p) - k + 1):
            w = p[i : i + k]
            seen[tuple(min(w, w[::-1]))] = n
    return spark.createDataFrame([(i, list(m), [n]) for i, (m, n) in enumerate(sorted(seen.items()))], NODES)


def random_nodes(spark, seed):
    rnd = random.Random(seed)
    return nodes(spark, [([rnd.randint(1, 25) for _ in range(rnd.randint(3, 12))], rnd.randint(1, 9)) for _ in range(40)] + [([101, 102, 103, 104, 105, 101, 102], 4)], 3)


def key(r):
    return tuple(r["minimizers"]), tuple(r["abundances"]), r["circular"], r["abundance"]


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_compaction_in_one_task_or_many(spark, per_task):
    n = random_nodes(spark, 1)
    got = sorted((tuple(r["minimizers"]), tuple(r["abundances"]), r["circular"]) for r in graph.compact(n, 2, per_task).collect())
    assert got == regions.compacted([(tuple(r["minimizers"]), tuple(r["abundances"]), False) for r in n.collect()], 2)
    assert [x[0] for x in got if x[2]] == [(101, 102, 103, 104, 105, 101, 102)]


@pytest.mark.parametrize("per_task", [1000, 6])
def test_places_on_long_lists_and_rings(spark, per_task):
    rnd = random.Random(4)
    ids = rnd.sample(range(1000), 90)
    line, ring = ids[:60], ids[60:]
    rows = [(a, b) for a, b in zip(line, line[1:])] + [(line[-1], None)] + [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]])]
    got = {r["c"]: r for r in graph.chain_places(spark.createDataFrame(rows, "c long, next long"), per_task).collect()}
    assert len(got) == 90
    assert [got[c]["dist"] for c in line] == list(range(60)) and {got[c]["head"] for c in line} == {line[0]}
    assert sorted(got[c]["dist"] for c in ring) == list(range(30)) and all(got[c]["circular"] for c in ring) and not got[line[0]]["circular"]
    start = min(ring, key=lambda c: got[c]["dist"])
    at = ring.index(start)
    assert [got[c]["dist"] for c in ring[at:] + ring[:at]] == list(range(30))


@pytest.mark.parametrize("per_task", [1000, 5])
def test_components_with_a_hub(spark, per_task):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100, 101 + i) for i in range(30)] + [(200 + i, 201 + i) for i in range(25)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), len(edges), per_task).collect()}
    assert got == {(x, find(x)) for x in range(300) if find(x) != x}


BACK = list(range(1, 40))
SHAPES = [
    (BACK, 20), ([5, 6, 7, 900, 901, 9, 10, 11], 4), ([20, 21, 22, 800, 801, 802, 26, 27, 28], 9), ([22, 800, 801, 810, 802, 26, 27], 3),
    ([33, 34, 35, 700, 701], 2), ([101, 102, 103, 104, 105, 106, 101, 102], 7), ([950, 951, 952], 1),
]


def test_a_component_too_large_for_a_task_gives_the_same(spark):
    n = nodes(spark, [(w, min(n, 3)) for w, n in SHAPES], 3)

    def rows(**kw):
        return sorted((r["kind"], r["cutoff"], tuple(r["minimizers"]), tuple(r["abundances"]), r["circular"]) for r in graph.states(n, 2, 8, first=2.5, kinds=("state", "contig"), **kw).collect())

    assert rows() == rows(region=8, per_task=1000)


def test_superbubbles_collapse_to_the_heaviest_way():
    paths = [(tuple(w), n) for w, n in SHAPES]
    seen = {}
    for m, n in paths:
        for i in range(len(m) - 2):
            w = m[i : i + 3]
            seen[min(w, w[::-1])] = n
    unitigs = regions.simplified([(m, (n,), False) for m, n in sorted(seen.items())], 2, 8)
    # One way is left through each bubble, and the tip is gone; the single isolated one is dropped only when written.
    assert [u[0] for u in unitigs if not u[2]] == [tuple([*range(1, 23), *range(23, 40)]), (950, 951, 952)]
    assert regions.lasting(unitigs, 2) == [u for u in unitigs if u[0] != (950, 951, 952)]
    # At no floor does the weak side win, however long.
    g = regions.Region([((1, 2, 3), (9,), False), ((2, 3, 4, 5), (2, 2), False), ((2, 3, 6, 7, 8, 4, 5), (3, 3, 3, 3, 3), False), ((4, 5, 9), (9,), False)], 2)
    found = regions.superbubble(g, 0, 20)
    assert found and found[0] >> 1 == 3 and {c >> 1 for c in regions.heaviest(g, 0, *found)} == {2}


def test_compaction_is_idempotent_and_edges_have_mirrors(spark):
    u = graph.compact(random_nodes(spark, 2), 2)
    lines = u.where("not circular").select("node", "minimizers", "abundances")
    assert sorted(r[0] for r in lines.select(F.sort_array("minimizers")).collect()) == sorted(r[0] for r in graph.compact(lines, 2).select(F.sort_array("minimizers")).collect())
    e = {tuple(r) for r in graph.oriented_edges(lines, 2).collect()}
    palindromes = {r[0] for r in lines.where(F.col("minimizers") == F.reverse("minimizers")).select("node").collect()}
    for a, ar, b, br in e:
        if a not in palindromes and b not in palindromes:
            assert (b, not br, a, not ar) in e


def test_tips_and_bubbles(spark):
    backbone = list(range(1, 30))
    tip = [900, 901, 12, 13, 14]
    bubble = [18, 19, 20, 700, 701, 22, 23, 24]
    n = nodes(spark, [(backbone, 9), (tip, 2), (bubble, 3)], 3)
    u = graph.compact(n, 2)
    gone = graph.simple_bubbles(u, graph.oriented_edges(u, 2), 10).join(u, "node").collect()
    assert len(gone) == 1 and gone[0]["abundance"] == 3
    clipped = graph.tips(u, graph.oriented_edges(u, 2), 5).join(u, "node").collect()
    assert [r["abundance"] for r in clipped] == [2]
    final = graph.simplify(n, 2, 10).collect()
    assert len(final) == 1 and final[0]["minimizers"] in (backbone, backbone[::-1])


def test_progressive_filter_and_selection(spark):
    n = nodes(spark, [(list(range(1, 20)), 20), (list(range(50, 60)), 2)], 3)
    shots = graph.progressive(n, 2, 3)
    assert shots.where("cutoff = 0").count() == 2
    picked = graph.select_contigs(shots, 3).collect()
    assert sorted(r["abundance"] for r in picked) == [2.0, 20.0]
    assert regions.after(1.1) == pytest.approx(1.21) and regions.after(1000.0) == 1010.0


def test_a_unitig_not_taken_bars_no_other(spark):
    # W shares 3, 4, 5 with V and V shares 5, 6, 7 with U: W takes V's place, so U stays.
    w, v, u, x = [1, 2, 3, 4, 5], [3, 4, 5, 6, 7], [9, 7, 6, 5], [20, 21, 22]
    rows = [(10.0, w, 30.0, False), (6.0, v, 20.0, False), (1.1, u, 9.0, False), (1.1, w, 25.0, False), (0.0, x, 1.0, False), (6.0, x, 11.0, False)]
    shots = spark.createDataFrame(rows, "cutoff double, minimizers array<long>, abundance double, circular boolean")
    picked = graph.select_contigs(shots, 3).collect()
    assert sorted((r["cutoff"], r["minimizers"]) for r in picked) == [(0.0, x), (1.1, u), (10.0, w)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], NODES)
    assert graph.compact(none, 2).count() == graph.compact(none, 2, 3).count() == 0
    assert graph.progressive(none, 2, 3).count() == 0


def test_ordered_ids_and_neighbourhood(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(1000), 200)], "v int").repartition(5)
    got = graph.ordered_ids(rows, ["v"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(200)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    e = spark.createDataFrame([(i, i + 1) for i in range(10)], "src long, dst long")
    near = {tuple(r) for r in graph.neighbourhood(e, spark.createDataFrame([(3,)], "node long"), 2).collect()}
    assert near == {(3, 0), (4, 1), (5, 2)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_of_hot_keys(spark, how):
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 3000, 2)] + [(7, "r7")], "id long, name string")
    want = sorted(map(str, left.join(right.withColumnRenamed("id", "k"), "k", how).collect()))
    assert sorted(map(str, skew.lookup_join(left, "k", right, "id", how).collect())) == want
    assert sorted(map(str, skew.lookup_join(left, "k", right, "id", how, rows=3001).collect())) == want


def test_depth_sweep(spark):
    iv = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (2, 4, 4), (None, 1, 2), (3, None, 4)], "k int, s int, e int")
    steps = intervals.depth_steps(iv, "k", "s", "e")
    assert sorted(map(tuple, steps.collect())) == [(1, 0, 3, 1), (1, 3, 5, 2), (1, 5, 8, 1), (1, 8, 9, 1)]
    assert [tuple(r) for r in intervals.regions(steps, "k", F.col("depth") >= 1).collect()] == [(1, 0, 9)]


def test_a_simulated_genome_comes_back(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    genome = "".join(rng.choice(list("ACGT"), 5000))
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 4000))
        s = genome[a : a + 1000]
        rows.append((i, flip(s) if rng.random() < 0.5 else s, None))
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    for compress in (False, True):
        p = assembly.Parameters(density=0.05, compress=compress, min_contig_coverage=0)
        got = assembly.assemble(reads, p, 4).collect()
        assert len(got) == 1 and got[0]["length"] > 4600
        assert got[0]["seq"] in genome or flip(got[0]["seq"]) in genome


def test_later_passes_keep_what_occurs_once(spark):
    # Parts of abundance 5 and 3 make a solid k-min-mer though it is seen once; one of abundance 1 doesn't.
    previous = spark.createDataFrame([([1, 2, 3], 5), ([2, 3, 4], 3), ([3, 4, 5], 1)], "km array<long>, abundance long")
    reads = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "read_id long, minimizers array<long>")
    got = assembly.counted(reads, 4, assembly.Parameters(first_k=3), previous).collect()
    assert [(r["km"], r["abundance"]) for r in got] == [([1, 2, 3, 4], 3)]


def test_small_contigs_come_back(spark):
    from strandwise.operators import contigs

    rows = lambda *x: spark.createDataFrame(list(x), "contig long, minimizers array<long>")
    got = contigs.without_contained(rows((2, [4, 3, 2]), (3, [7, 8, 9]), (4, [16, 17, 18, 19])), rows((1, [1, 2, 3, 4, 5, 6])), 3)
    assert sorted(r["contig"] for r in got.collect()) == [3, 4]


@pytest.mark.parametrize("correction", [False, True])
def test_prepared_reads_are_filtered(spark, correction):
    import numpy as np

    from strandwise.operators import align

    assert align.purge_palindromes([2, 1, 2, 2, 2, 1], 4, 8) == [2, 2, 2, 1]
    rng = np.random.default_rng(5)
    half = "".join(rng.choice(list("ACGT"), 900))
    hairpin = half + half.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    unit = "".join(rng.choice(list("ACGT"), 5))
    reads = spark.createDataFrame([(1, hairpin, None), (2, unit * 300, None)], "read_id long, seq string, qual string")
    p = assembly.Parameters(density=0.4, density_correction=0.4, compress=False, correction=correction, max_k=60)
    got = {r["read_id"]: r["minimizers"] for r in assembly.prepared_reads(reads, p).collect()}
    assert set(got) == {1} and len(got[1]) > 100
    assert not any(got[1][i : i + k] == got[1][i : i + k][::-1] for k in range(4, 60) for i in range(len(got[1]) - k + 1))
