import random

import numpy as np

from strandwise.operators import align, minimize


def test_chain_takes_the_colinear_anchors():
    ref = np.array([10, 50, 60, 90, 130])
    query = np.array([5, 45, 900, 86, 125])
    score, members = align.chain(ref, query)
    assert members == [0, 1, 3, 4] and score == 80 - 0 - 1 - 1
    assert align.chain(np.array([], int), np.array([], int)) == (0.0, [])


def test_overlap_alignment():
    assert align.overlap_align([1, 2, 3, 4, 5], [3, 4, 5, 6]) == [(2, 0), (3, 1), (4, 2)]
    pairs = align.overlap_align([1, 2, 3, 4, 5, 6], [2, 3, 9, 4, 5, 6])
    assert [(i, j) for i, j in pairs if i >= 0 and j >= 0] == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_palindromes_are_purged():
    assert align.purge_palindromes([1, 2, 3, 4, 5], 4, 10) == [1, 2, 3, 4, 5]
    out = align.purge_palindromes([9, 1, 2, 2, 1, 7, 8], 4, 7)
    assert all(w != w[::-1] for k in range(4, 7) for w in (out[i : i + k] for i in range(len(out) - k + 1)))


def test_correction_lowers_the_error():
    rnd = random.Random(1)
    truth = [rnd.randint(1, 10**6) for _ in range(60)]

    def noisy():
        out = []
        for m in truth:
            x = rnd.random()
            if x < 0.04:
                continue
            out.append(rnd.randint(1, 10**6) if x < 0.08 else m)
        return out if rnd.random() < 0.5 else out[::-1]

    wrong = lambda a: len(set(a) ^ set(truth))
    before, after = 0, 0
    for _ in range(10):
        reads = [noisy() for _ in range(12)]
        before += wrong(reads[0])
        after += wrong(align.correct(reads[0], [(r, [1] * len(r)) for r in reads[1:]]))
    assert after < before / 3
    assert align.correct([], [([1, 2], [1, 1])]) == [] and align.correct([1, 2, 3], []) == [1, 2, 3]


def test_edit_path_and_cigar():
    rnd = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        a, b = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 20))) for _ in range(2))
        ops = align.cigar_ops(align.edit_path(a, b))
        assert sum(n for n, op in ops if op != "=") == distance(a, b)
        assert sum(n for n, op in ops if op in "=XD") == len(a) and sum(n for n, op in ops if op in "=XI") == len(b)
    assert align.cigar_matches("10=2X3I5M") == 15


def test_consensus_outvotes_errors(spark):
    rnd = random.Random(5)
    truth = "".join(rnd.choice("ACGT") for _ in range(120))

    def noisy(rate):
        return "".join(rnd.choice(["", "A", c + "C"]) if rnd.random() < rate else c for c in truth)

    backbone, pieces = noisy(0.08), [(noisy(0.05), "") for _ in range(21)]
    assert align.consensus(backbone, pieces) == truth
    rows = [(1, 0, backbone, s, None, 1.0) for s, _ in pieces]
    got = align.window_consensus(spark.createDataFrame(rows, "contig_id long, w int, backbone string, seq string, qual string, score double")).collect()
    assert [r["seq"] for r in got] == [truth]
    assert align.consensus("ACGT", []) == "ACGT"


def test_choices_of_alignments(spark):
    from strandwise.operators import overlaps

    rows = [(1, 0, 10, 5, 1), (1, 5, 15, 9, 2), (1, 15, 20, 1, 3), (1, 0, 4, 2, 4), (1, 5, 15, 8, 5), (None, 0, 9, 1, 6), (2, 3, 3, 1, 7), (3, 0, 5, None, 8)]
    df = spark.createDataFrame(rows, "k long, s int, e int, score int, i int")
    assert sorted((r["k"], r["i"]) for r in overlaps.disjoint(df, "k", "s", "e", "score", ["i"]).collect()) == [(1, 2), (1, 3), (1, 4), (3, 8)]
    assert sorted(r["i"] for r in overlaps.disjoint(df, "k", "s", "e", "score", ["i"], 5).collect()) == [1, 2, 3, 4, 8]
    deep = spark.createDataFrame([(1, 0, 10, i, i) for i in range(5)] + [(1, 8, 12, 0, 9)], df.schema)
    assert sorted(r["i"] for r in overlaps.thinned(deep, "k", "s", "e", "score", ["i"], 2).collect()) == [3, 4, 9]


def test_the_best_along_a_reference(spark):
    from strandwise.operators import overlaps

    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), i % 37, a, a + rnd.randint(0, 60), rnd.choice([None, 1, 2, 3, 4])) for i in range(120) for a in [rnd.randint(0, 90)]]
    want = set()
    for k in (0, 1):
        for p in range(160):
            here = {(-1 if w is None else w, o) for key, o, a, z, w in rows if key == k and a <= p <= z}
            want |= {(k, o) for _, o in sorted(here, key=lambda x: (-x[0], x[1]))[:3]}
    df = spark.createDataFrame(rows + [(None, 1, 0, 9, 9), (0, 99, 5, 2, 9)], "k int, o int, a int, z int, w int")
    assert {tuple(r) for r in overlaps.top_along(df, "k", "a", "z", "w", "o", 3).collect()} == want


def test_alignments_that_may_correct(spark):
    rows = [(1, 2, True, 80.0, 5, 0, 900, 100, 1000, [0, 2, 3, 4, 6], [1, 2, 4, 5, 7]), (1, 3, False, 40.0, 2, 10, 20, 30, 40, [1, 2], [5, 4])]
    found = spark.createDataFrame(rows, align.CHAINS)
    sizes = spark.createDataFrame([(1, 1100, 9), (2, 1000, 8), (3, 500, 4)], "query long, query_len int, query_n int")
    got = {r["reference"]: r for r in align.chain_alignments(found, sizes, 15).collect()}
    # Steps on the reference 2, 1, 1, 2 and on the query 1, 2, 1, 2: one mismatch between, none before, one behind.
    r = got[2]
    assert (r["matches"], r["mismatches"], r["insertions"], r["deletions"], r["align_length"], r["hang_start"], r["hang_end"]) == (5, 2, 1, 1, 900, 0, 85)
    assert abs(r["identity"] - (5 / 8) ** (1 / 15)) < 1e-9
    assert got[3]["mismatches"] == 2 and got[3]["hang_start"] == 10
    good = align.good_alignments(align.chain_alignments(found, sizes, 15), 800, 0.96).collect()
    assert [x["reference"] for x in good] == [2]


def test_chains_of_a_frame(spark):
    rows = [(1, 2, 0, 0, 10 * i, 10 * i + 3, True) for i in range(5)] + [(1, 3, 0, 0, 10 * i, 100 - 10 * i, False) for i in range(4)] + [(1, 4, 0, 0, 5, 5, True)]
    df = spark.createDataFrame(rows, "query long, reference long, q_i int, r_i int, q_pos int, r_pos int, same_strand boolean")
    got = {r["reference"]: (r["same_strand"], r["n_anchors"], r["r_start"], r["r_end"], r["q_start"], r["q_end"]) for r in align.chain_anchors(df).collect()}
    assert got == {2: (True, 5, 3, 43, 0, 40), 3: (False, 4, 70, 100, 0, 30)}


def test_anchors_leave_out_only_the_most_frequent_minimizer(spark):
    from strandwise.operators import overlaps
    from strandwise.plans import assembly

    rng = np.random.default_rng(4)
    long = ["".join(rng.choice(list("ACGT"), 1600)) for _ in range(50)]
    rows = [(i, s, None) for i, s in enumerate(long)] + [(100 + i, long[0][200:500], None) for i in range(5)]
    reads = minimize.minimizer_reads(spark.createDataFrame(rows, "read_id long, seq string, qual string"), 15, 0.05)
    n = reads.where("read_id = 100").first()["minimizers"]
    p = assembly.read_anchors(reads)
    got = align.chain_anchors(overlaps.anchors(p, p, exclude_self=True)).where("query >= 100 and reference = 0").collect()
    assert len(got) == 5 and {r["n_anchors"] for r in got} == {len(n) - 2}


def test_reads_on_contigs_need_two_anchors(spark):
    from strandwise.operators import contigs

    c = spark.createDataFrame([(7, [1, 2, 3, 4, 5, 6, 7, 8])], "contig long, minimizers array<long>")
    m = spark.createDataFrame([(1, [3, 4, 5]), (2, [6, 5, 4]), (3, [1, 2]), (4, [])], "read_id long, minimizers array<long>")
    got = {r["query"]: (r["same_strand"], r["r_at"], r["q_at"]) for r in contigs.read_paths(c, m).collect()}
    assert got == {1: (True, [2, 3], [0, 1]), 2: (False, [3, 4], [2, 1])}


def test_equal_pieces_and_ends_change_no_alignment():
    plain = lambda t, q: sum(n for n, op in align.cigar_ops(align.edit_path(t, q)) if op != "=")
    assert align.edit_path("ACGT" * 200, "ACGT" * 200) == "800="
    assert align.edit_path("AAX", "AY") == "1D1=1X" and align.edit_path("AAB", "AB") == "1D2=" and align.edit_path("", "AB") == "2I"
    assert plain("ACGTTACG", "ACTTACG") == 1 and plain("ACG", "") == 3
    assert align.consensus("ACGT", [("ACGT", ""), ("ACGT", "IIII")], False) == "ACGT"
    assert align.consensus("ACGT", [("ACGT", ""), ("AGGT", ""), ("AGGT", "")], False) == "AGGT"
