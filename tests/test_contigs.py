import random

import numpy as np

from strandwise.operators import contigs


def test_repeats_are_cut_and_dropped(spark):
    rnd = random.Random(1)
    unique = "".join(rnd.choice("ACGT") for _ in range(3000))
    rows = [(1, unique, 3.0), (2, "ACGTTGCA" * 300, 3.0), (3, "ACGTTGCA" * 300, 30.0), (4, unique[:1200] + "ACGTTGCAGG" * 200, 3.0), (5, "", 3.0), (6, None, 3.0)]
    got = {r["contig"]: r["seq"] for r in contigs.without_repetitive(spark.createDataFrame(rows, "contig long, seq string, coverage double")).collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[1] == unique and got[3] == rows[2][1]
    assert 1000 < len(got[4]) < 2000
    kept = contigs.without_low_complexity(spark.createDataFrame(rows + [(7, "A" * 500, 1.0)], "contig long, seq string, coverage double"))
    assert 7 not in {r["contig"] for r in kept.collect()} and 1 in {r["contig"] for r in kept.collect()}


def test_overlapping_ends_are_trimmed(spark):
    long, short = list(range(1, 60)), list(range(50, 60)) + list(range(100, 120))
    inside = list(range(10, 25))[::-1]
    df = spark.createDataFrame([(1, long), (2, short), (3, inside), (4, list(range(200, 210)))], "contig long, minimizers array<long>")
    got = {r["contig"]: r["minimizers"] for r in contigs.trim_overlaps(df, 4).collect()}
    assert set(got) == {1, 2, 4} and got[1] == long and got[2][-20:] == list(range(100, 120)) and len(got[2]) == 23
    rest = contigs.without_contained(df.where("contig in (3, 4)"), df.where("contig = 1"), 4)
    assert [r["contig"] for r in rest.collect()] == [4]


def test_breaking_at_unbridged_repeats(spark):
    starts, ends = [0, 20, 25, 60], [19, 24, 59, 80]
    assert contigs.fragment_paths(starts, ends, [5, 30, 5, 6], set(), 10) == [(0, 0), (1, 1), (2, 3)]
    assert contigs.fragment_paths(starts, ends, [5, 30, 5, 6], {(0, 2)}, 10) == [(0, 3)]
    f = spark.createDataFrame([(1, i, a, b, c) for i, (a, b, c) in enumerate(zip(starts, ends, [5.0, 30.0, 5.0, 6.0]))], "contig long, fragment int, f_start int, f_end int, coverage double")
    none = spark.createDataFrame([], "contig long, f1 int, f2 int, n long")
    assert sorted(map(tuple, contigs.break_unbridged(f, none, 10).collect())) == [(1, 0, 19), (1, 20, 24), (1, 25, 80)]


def test_suspect_reads_and_dereplication(spark):
    al = spark.createDataFrame([(1, 0, 400), (1, 0, 420), (1, 700, 1200), (1, 690, 1200), (2, 0, 1200), (2, 0, 1200)], "read_id long, start int, end int")
    lengths = spark.createDataFrame([(1, 1200), (2, 1200)], "read_id long, length int")
    assert [r[0] for r in contigs.suspect_reads(al, lengths).collect()] == [1]
    c = spark.createDataFrame([(1, "A" * 900, 2.0), (2, "C" * 5000, 9.0), (3, "G" * 800, 2.0), (4, "T" * 700, 8.0)], "contig long, seq string, coverage double")
    m = spark.createDataFrame([(1, 2, 10, 300, 0.95), (3, 2, 0, 800, 0.99), (4, 2, 0, 700, 0.99), (1, 2, 400, 890, 0.5)], "a long, b long, a_start int, a_end int, identity double")
    got = {r["contig"]: len(r["seq"]) for r in contigs.dereplicated(c, m).collect()}
    assert got == {1: 600, 2: 5000, 4: 700}


def test_polishing_lowers_the_error(spark):
    rng, rnd = np.random.default_rng(7), random.Random(7)
    truth = "".join(rng.choice(list("ACGT"), 3000))
    noisy = lambda s, rate: "".join(rnd.choice(["", "A", c + "G"]) if rnd.random() < rate else c for c in s)
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = []
    for i in range(50):
        a = int(rng.integers(0, 1500))
        s = noisy(truth[a : a + 1500], 0.02)
        reads.append((i, flip(s) if i % 2 else s))
    # Only what reads cover well: ends have one read's vote at best.
    truth = truth[300:2700]
    draft = noisy(truth, 0.01)
    got = contigs.polished(spark.createDataFrame([(1, draft), (2, "ACGT")], "contig long, seq string"), spark.createDataFrame(reads, "read_id long, seq string"))
    out = {r["contig"]: r["seq"] for r in got.collect()}

    def edits(a, b):
        from strandwise.operators.align import cigar_ops, edit_path

        return sum(n for n, op in cigar_ops(edit_path(a, b)) if op != "=")

    assert out[2] == "ACGT"
    assert edits(truth, out[1]) < edits(truth, draft) / 3
