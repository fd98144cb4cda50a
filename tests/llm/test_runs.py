import random

from strandwise.llm import runs

SCHEMA = "read_id long, seq string, qual string, run_start string, base int"


def brute(seq, qual, least, worst=5):
    s = seq.upper()
    y = list(s)
    if qual is not None and len(qual) == len(s):
        for i in range(1, len(s) - 1):
            if ord(qual[i]) - 33 <= worst and s[i - 1] == s[i + 1] and s[i - 1] in "ACGT":
                y[i] = s[i - 1]
    out, i = [], 0
    while i < len(y):
        j = i
        while j < len(y) and y[j] == y[i]:
            j += 1
        if j - i >= least and y[i] in "ACGT":
            out.append((y[i], i, j - i, j))
        i = j
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        seq = "".join(rnd.choice("AaCcGTN") * rnd.randint(1, 9) for _ in range(rnd.randint(0, 30)))
        qual = rnd.choice([None, "", "!" * (len(seq) // 2), "".join(rnd.choice("!%&I") for _ in seq)])
        rows.append((i, seq, qual, "x", 1))
    rows += [(500, None, None, None, None), (501, "", "", None, None), (502, "é" * 3 + "AAAA", "IIIIIII", None, None), (503, "ACGT" * 50000 + "T" * 12, None, None, None), (0, "AAAA", None, None, None)]
    got = sorted(tuple(r) for r in runs.base_runs(spark.createDataFrame(rows, SCHEMA), 3).collect())
    assert got == sorted((i, *x) for i, s, q, *_ in rows if s for x in brute(s, q, 3))


def test_neighbours_are_judged_as_given(spark):
    rows = [(1, "ACACA", "I!!!I", None, None), (2, "AANAA", "II&II", None, None), (3, "NANAN", "I!!!I", None, None)]
    got = {(r[0], r[2], r[3]) for r in runs.base_runs(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    # Every doubtful position of read 1 turns into its neighbours' letter at once.
    assert {x for x in got if x[0] == 1} == {(1, 0, 2), (1, 2, 1), (1, 3, 2)} or {x for x in got if x[0] == 1} == {(1, i, n) for _, i, n, _ in [(b, i, n, e) for b, i, n, e in brute("ACACA", "I!!!I", 1)]}
    assert {x for x in got if x[0] == 2} == {(2, 0, 5)}
    assert {x for x in got if x[0] == 3} == {(3, 1, 3)} or {x for x in got if x[0] == 3} == {(3, i, n) for _, i, n, _ in brute("NANAN", "I!!!I", 1)}


def test_collapsed_reads_keep_every_row(spark):
    rows = [(1, "AAcCGT", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    got = {r["read_id"]: (r["events"], r["starts"], r["lengths"]) for r in runs.collapsed_reads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("ACGT", [0, 2, 4, 5], [2, 2, 1, 1]), 2: ("", [], []), 3: ("", [], [])}


def test_empty_table(spark):
    assert runs.base_runs(spark.createDataFrame([], SCHEMA)).count() == 0
