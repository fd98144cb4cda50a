import random
from collections import defaultdict

import pytest

from strandwise.llm import pack

SCHEMA = "doc_id long, n_tokens int, rank int, capacity string"


def check(rows, out, capacity, capacities):
    items = defaultdict(list)
    for r in out:
        items[r["doc_id"]].append(r)
    bins = defaultdict(int)
    for r in out:
        bins[r["container_id"]] += r["n_tokens"]
    for r in out:
        assert bins[r["container_id"]] == r["used"] <= r["capacity"] <= capacity
        assert r["capacity"] == min(c for c in capacities if c >= r["used"])
    want = sorted(n for _, n, *_ in rows if n)
    parts = defaultdict(int)
    for r in out:
        if r["piece"]:
            assert r["piece_start"] == r["piece"] * capacity
        parts[r["doc_id"]] += r["n_tokens"]
    assert sum(parts.values()) == sum(want)
    return len(bins)


def test_everything_is_placed_and_only_long_items_are_cut(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 7, 30, 64, rnd.randint(1, 64), rnd.randint(60, 300)]), 1, "x") for i in range(700)]
    rows += [(1000 + i, 33, None, None) for i in range(350)] + [(2000, 0, None, None), (2001, None, None, None), (3, 12, None, None)]
    out = pack.packed(spark.createDataFrame(rows, SCHEMA), 64, [16, 32], items_per_lane=50).collect()
    n = check(rows, out, 64, [16, 32, 64])
    assert len(out) == len({(r["doc_id"], r["piece"], r["container_id"], r["piece_start"]) for r in out})
    for i, size, *_ in rows[:700]:
        pieces = [r for r in out if r["doc_id"] == i and i != 3]
        assert i == 3 or len(pieces) == -(-size // 64)
    # Half the items of 33 tokens take a container of their own each; the rest fills up.
    assert n >= -(-sum(r["n_tokens"] for r in out) // 64)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_near_the_bound(seed):
    rnd = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[rnd.randint(1, 700)] += 1
    kinds = pack.plan(dict(histogram), [2048])
    placed = defaultdict(int)
    for _, number, contents in kinds:
        assert sum(s * n for s, n in contents) <= 2048
        for s, n in contents:
            placed[s] += n * number
    assert placed == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(number for _, number, _ in kinds) <= -(-total // 2048) + 2


def test_a_capacity_that_suits_is_opened():
    kinds = pack.plan({600: 400}, [620, 2048])
    unused = 1 - sum(n * sum(s * k for s, k in c) for _, n, c in kinds) / sum(c * n for c, n, _ in kinds)
    assert unused < 0.04 and kinds == [(620, 400, [(600, 1)])]
    # With items that fill the rest, the large capacity costs nothing.
    assert pack.plan({600: 3, 248: 1}, [620, 2048]) == [(2048, 1, [(600, 3), (248, 1)])]


@pytest.mark.parametrize("seed", range(3))
def test_joint_choice_never_wastes_more_than_one_length(seed):
    rnd = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(2047, int(rnd.lognormvariate(5.5, 1)) + 1)] += 1

    def room(limits):
        return sum(c * n for c, n, _ in pack.plan(dict(histogram), limits))

    assert room([256, 512, 1024, 2048]) <= room([2048])


def test_empty_and_bounds(spark):
    df = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert pack.packed(df).count() == 0
    assert pack.packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack.packed(df, 64, [128])
    report = pack.fill_report(pack.packed(spark.createDataFrame([(1, 30, 0, ""), (2, 34, 0, "")], SCHEMA), 64)).first()
    assert (report["containers"], report["tokens"], report["room"], report["unused"]) == (1, 64, 64, 0.0)
