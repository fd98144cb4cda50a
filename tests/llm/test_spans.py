import random
from collections import defaultdict

import pytest

from strandwise.llm import spans

SCHEMA = "read_id long, seq string, start string, bucket int"


def brute(rows, w):
    """Covered spans, and letters covered by windows an earlier read has."""
    where = defaultdict(set)
    ok = lambda x: not set(x) - set("ACGT")
    for i, s in rows:
        for k in range(len(s) - w + 1):
            where[s[k : k + w].upper()].add(i)
    out, repeated = set(), defaultdict(set)
    for i, s in rows:
        s = s.upper()
        covered = [False] * len(s)
        for k in range(len(s) - w + 1):
            x = s[k : k + w]
            if ok(x) and len(where[x]) > 1:
                covered[k : k + w] = [True] * w
                if min(where[x]) < i:
                    repeated[i] |= set(range(k, k + w))
        k = 0
        while k < len(s):
            z = k
            while z < len(s) and covered[z]:
                z += 1
            if z > k:
                out.add((i, k, z - k))
            k = z + 1
    return out, {i: len(x) for i, x in repeated.items()}


def made(seed, n=60, adapter="ACGTTGCAGGCTAACCGTAGGATC"):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("ACGT") for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(n):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 80)))
        if rnd.random() < 0.5:
            p = rnd.choice(pool)
            a = rnd.randint(0, 60)
            s += p[a : a + rnd.randint(10, 60)]
        if rnd.random() < 0.4:
            s = adapter + s
        if rnd.random() < 0.2:
            s = s.lower()
        if rnd.random() < 0.1 and s:
            s = s[: len(s) // 2] + "N" + s[len(s) // 2 + 1 :]
        rows.append((i, s))
    return rows + rows[:4]


@pytest.mark.parametrize("window,per_bucket", [(20, 250_000), (20, 3), (33, 2), (60, 1), (71, 2)])
def test_against_brute_force(spark, window, per_bucket):
    """Small buckets make adapters overfull, so that the routing by content is used."""
    rows = made(window)
    rows += [(100 + i, "A" * 70 + "C" * i) for i in range(3)]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in rows] + [(900, None, None, None), (901, "", None, None), (None, "ACGT" * 30, None, None)], SCHEMA).repartition(3)
    st = spans.shared_stretches(df, window, windows_per_bucket=per_bucket, buckets_per_task=1 << 20).cache()
    want, repeated = brute(rows, window)
    assert {tuple(r) for r in spans.covered_spans(st).collect()} == want
    later = {}
    for r in spans.covered_spans(st.where("later")).collect():
        later[r[0]] = later.get(r[0], 0) + r[2]
    assert later == repeated


def test_report_keeps_reads_without_spans(spark):
    df = spark.createDataFrame([(1, "ACGTACGTAC", None, None), (2, "ttACGTACGTACtt", None, None), (3, None, None, None), (4, "GGGGGGGGGG", None, None)], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in spans.shared_letters(df, spans.shared_stretches(df, 8)).collect()}
    assert got == {1: (10, 10, 0), 2: (14, 10, 10), 3: (0, 0, 0), 4: (10, 0, 0)}


def test_empty_table_and_bounds(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.shared_stretches(df).count() == 0
    with pytest.raises(ValueError):
        spans.shared_stretches(df, 1)


def test_windows_of_any_length_and_a_bound_on_the_overfull(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice("ACGT") for _ in range(700))
    rows = [(1, text), (2, text[100:500] + "N" + text[:90]), (3, text[:320]), (4, "ACGT" * 100), (5, "ACGT" * 90)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    for window in (65, 300):
        want, _ = brute(rows, window)
        for bound in (1, 100):
            assert {tuple(r) for r in spans.covered_spans(spans.shared_stretches(df, window, windows_per_bucket=40, hot_bound=bound)).collect()} == want


def test_removal_leaves_one_copy(spark):
    rows = [(1, "ttGATTACAGATTACA"), (2, "CCGATTACAGATTACACCgattacagaCC"), (3, None), (4, ""), (5, "GGGG")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = {r["read_id"]: (r["seq"], r["n_removed"]) for r in spans.without_repeated(df, spans.shared_stretches(df, 8)).collect()}
    assert got == {1: ("ttGATTACAGATTACA", 0), 2: ("CCCCCC", 23), 3: (None, 0), 4: ("", 0), 5: ("GGGG", 0)}
