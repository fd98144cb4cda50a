import random

import numpy as np
import pytest

from strandwise.operators import contigs, minimize
from strandwise.operators.align import cigar_ops, edit_path
from strandwise.plans import assembly

READS = "read_id long, seq string, qual string"


def flip(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def genome(seed, n):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def test_a_ring_is_closed(spark):
    ring = genome(11, 3000)
    rnd = random.Random(2)
    starts = [*range(0, 3000, 60)]
    rows = [(i, s if rnd.random() < 0.5 else flip(s), None) for i, a in enumerate(starts) for s in [(ring + ring)[a : a + 1000]]]
    p = assembly.Parameters(density=0.05, compress=False, min_contig_coverage=0, polish=False)
    got = assembly.assemble(spark.createDataFrame(rows, READS), p, 5).collect()
    assert len(got) == 1 and got[0]["circular"] and got[0]["length"] == 3000
    assert got[0]["seq"] in ring + ring or flip(got[0]["seq"]) in ring + ring
    assert got[0]["header"].endswith("circular=yes")


def test_reads_with_errors_come_back_whole(spark):
    truth, rnd = genome(12, 3000), random.Random(3)
    noisy = lambda s: "".join(rnd.choice(["", "A", "C", c + "G"]) if rnd.random() < 0.01 else c for c in s)
    rows = []
    for i in range(70):
        a = rnd.randint(0, 1800)
        s = noisy(truth[a : a + 1200])
        rows.append((i, s if rnd.random() < 0.5 else flip(s), None))
    p = assembly.Parameters(platform="ont", density=0.05, density_correction=0.1, min_overlap=300, min_identity=0.9, min_contig_coverage=0)
    got = assembly.assemble(spark.createDataFrame(rows, READS), p, 5).collect()
    best = max(got, key=lambda r: r["length"])
    assert best["length"] > 2700
    # Ends that the contig doesn't reach aren't errors.
    edits = min(sum(n for n, op in cigar_ops(edit_path(truth, s)) if op != "=") for s in (best["seq"], flip(best["seq"])))
    assert edits - (3000 - best["length"]) < 20


def test_reads_are_laid_along_contigs(spark):
    c = spark.createDataFrame([(1, [1, 2, 3, 4], False), (2, [7, 8, 7], True), (3, [50, 51], False)], "contig long, minimizers array<long>, circular boolean")
    # Minimizers of two letters at the places given; the second read lacks 2 and lies on the other strand.
    reads = [(1, "AATTCCAA", None), (2, flip("AAGTTCCGAAC"), None), (3, "GGTACCAGG", None), (4, "", None)]
    m = spark.createDataFrame([(1, [1, 2, 3], [0, 2, 5], [2, 4, 7]), (2, [4, 3, 1], [1, 4, 9], [3, 6, 11]), (3, [7, 8, 7], [0, 4, 7], [2, 6, 9]), (4, [], [], [])], "read_id long, minimizers array<long>, start array<int>, stop array<int>")
    got = {r["contig"]: r["seq"] for r in contigs.laid_out(c, m, spark.createDataFrame(reads, READS)).collect()}
    assert set(got) == {1, 2}
    assert got[2] == "GGTACCA"


def test_self_overlaps_and_uncovered_ends(spark):
    s = genome(13, 2500)
    rows = spark.createDataFrame([(1, s + s[:600]), (2, s), (3, ""), (4, None)], "id long, seq string")
    got = {r["id"]: r["overlap"] for r in contigs.self_overlaps(rows, density=0.1).collect()}
    assert set(got) == {1} and abs(got[1] - 600) < 60
    cover = spark.createDataFrame([(9, 1, 200, 1200, 0), (8, 1, 900, 2000, 0)], "query long, reference long, r_start int, r_end int, q_start int")
    cut = {r["contig"]: r["seq"] for r in contigs.ends_without_cover(spark.createDataFrame([(1, s), (2, "ACGT")], "contig long, seq string"), cover).collect()}
    assert cut == {1: s[200:2015], 2: "ACGT"}


@pytest.mark.parametrize("handed", [10, 0])
def test_repetitive_minimizers_go_with_their_positions(spark, handed):
    m = spark.createDataFrame([(1, [5, 6, 5, 7], [0, 3, 8, 9], 40), (2, [], [], 0), (3, [5], [1], 20)], "read_id long, minimizers array<long>, pos array<int>, read_len int")
    got = sorted(map(tuple, minimize.without_repetitive(m, spark.createDataFrame([(5, 3)], "minimizer long, n long"), handed).collect()))
    assert got == [(1, [6, 7], [3, 9], 40), (2, [], [], 0), (3, [], [], 20)]
    counts = spark.createDataFrame([(i, 10 - i // 3) for i in range(12)], "minimizer long, n long")
    assert sorted(r["minimizer"] for r in minimize.repetitive_minimizers(counts, 5 / 12).collect()) == [0, 1, 2, 3, 4]
    assert minimize.repetitive_minimizers(counts.limit(0)).count() == 0


def repeats_and_errors(seed):
    """Reads ``read_id, minimizers`` of two sequences that share repeats, some with a minimizer changed."""
    rnd = random.Random(seed)
    alphabet = [rnd.randrange(1 << 40) for _ in range(60)]
    part = lambda n: [rnd.choice(alphabet) for _ in range(n)]
    r, s = part(7), part(11)
    whole = [part(25) + r + part(20) + s + part(20) + r[::-1] + part(15) + s, part(18) + s + part(12) + r + r + part(12)]
    rows = []
    for i in range(90):
        w = rnd.choice(whole)
        a = rnd.randrange(len(w) - 12)
        m = w[a : a + rnd.randrange(10, 28)]
        if rnd.random() < 0.3:
            m = m[:5] + [rnd.choice(alphabet)] + m[6:]
        rows.append((i, m if rnd.random() < 0.5 else m[::-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_by_component_are_those_of_the_whole_table(spark, seed):
    m = spark.createDataFrame(repeats_and_errors(seed), "read_id long, minimizers array<long>")
    p = assembly.Parameters(density=0.05)
    row = lambda r: (r["kind"], r["k"], r["cutoff"], tuple(r["minimizers"]), r["abundance"], r["circular"])
    # Components end at different k; what is alive at the last one counts, and the short contigs on the way.
    near, far = ([row(r) for r in assembly.grown(m, 11, p, most).collect()] for most in (10**9, 0))
    last = max(r[1] for r in far)
    of = lambda rows: sorted(r for r in rows if (r[0] == "short" and r[1] < last) or (r[1] == last and r[0] in ("graph", "contig", "solid")))
    assert last == 11 and {r[0] for r in of(near)} >= {"graph", "contig", "solid"}
    assert of(near) == of(far)


def test_passes_take_no_more_jobs_for_a_larger_k(spark):
    m = spark.createDataFrame(repeats_and_errors(3), "read_id long, minimizers array<long>")
    sc, jobs = spark.sparkContext, []
    for last in (6, 20):
        sc.setJobGroup(f"passes-{last}", "")
        assembly.grown(m, last, assembly.Parameters(density=0.05)).count()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"passes-{last}")))
    assert jobs[0] == jobs[1] > 0


def test_no_reads_and_reads_of_nothing_solid_give_no_passes(spark):
    for rows in ([], [(1, "ACGT" * 3, None)], [(1, genome(14, 900), None)]):
        made = assembly.multi_k(spark.createDataFrame(rows, READS), assembly.Parameters(density=0.05, compress=False))
        assert made.unitigs.isEmpty() and made.contigs.isEmpty() and made.k == 4
