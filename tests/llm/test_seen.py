import numpy as np
import pytest

from strandwise.llm import seen

SCHEMA = "rec_id long, vec_hash_hi long, vec_hash_lo long, seen boolean, bucket string"
KNOWN = "vec_hash_hi long, vec_hash_lo long, rec_id string"


def brute(rows, known):
    first = {}
    for i, h, l, *_ in rows:
        if h is not None and l is not None:
            key, i = (h, l), float("inf") if i is None else i
            first[key] = min(first.get(key, i), i)
    given = {(h, l) for h, l, *_ in known}
    out = []
    for i, h, l, *_ in rows:
        if h is not None and l is not None and ((h, l) in given or first[h, l] < (float("inf") if i is None else i)):
            out.append(i)
    return sorted(out, key=str)


def found(spark, rows, known, **kw):
    a = seen.seen_before(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, KNOWN), **kw)
    return sorted((r[0] for r in seen.seen_ids(a).collect()), key=str)


def test_order_nulls_ties_and_clashing_columns(spark):
    rows = [
        (3, 1, 1, True, "x"), (1, 1, 1, False, None), (2, 1, 2, None, None), (5, None, 2, None, None), (6, 1, None, None, None),
        (7, 2, 2, None, None), (7, 2, 2, None, None), (8, 2, 2, None, None), (None, 9, 9, None, None), (4, 9, 9, None, None), (9, -5, -5, None, None),
    ]
    known = [(-5, -5, "a"), (None, 1, "b"), (-5, -5, "c")]
    assert found(spark, rows, known) == brute(rows, known) == sorted([3, 8, None, 9], key=str)


def test_a_hot_key_and_many_partitions(spark):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(6000) < 0.34, 7, rng.integers(0, 3000, 6000))
    rows = [(int(i), int(k), int(k) * 3 - 11, None, None) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    rows = [tuple(int(x) if isinstance(x, np.integer) else x for x in r) for r in rows]
    known = [(k, k * 3 - 11, None) for k in range(0, 3000, 17)]
    assert found(spark, rows, known, keys_per_filter=100) == brute(rows, known)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, 1, 1, None, None)], []) == []


def test_error_rate_is_measured_and_within_the_target(spark):
    rows = [(i, i * 7919, i * 104729, None, None) for i in range(20000)]
    a = seen.seen_before(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], KNOWN), target_fpp=0.02, keys_per_filter=2000, probes=4000)
    r = seen.error_rate(a, 0.02).first()
    assert r["records"] == 20000 and r["probes"] > 4000
    assert 0 < r["measured_fpp"] < 0.03
    # What is wrongly answered "seen" was never inserted.
    assert r["keys_inserted"] == 20000 - r["seen"] and r["seen"] < 20000 * 0.03


@pytest.mark.parametrize("target", [1e-2, 1e-4])
def test_the_filter_holds_its_rate_beyond_its_capacity(target):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, (2, 30000), dtype=np.uint64)
    f = seen.BlockedBloom(10000, target)
    f.insert(*keys)
    assert f.query(*keys).all()
    absent = rng.integers(0, 2**64, (2, 200000), dtype=np.uint64)
    assert f.query(*absent).mean() < 1.5 * target + 1e-5


def test_known_keys_set_the_partitions_and_repeats_take_no_room(spark):
    known = spark.createDataFrame([(i % 1000, i % 1000 + 7, None) for i in range(20000)], KNOWN)
    records = spark.createDataFrame([(i, i, i + 7, None, None) for i in range(0, 2000, 2)], SCHEMA)
    a = seen.seen_before(records, known, keys_per_filter=1000, probes=10).collect()
    figures = [r for r in a if r["inserted"] is not None]
    assert len(figures) == 21 and sum(r["inserted"] for r in figures) == 1500
    assert sorted(r["rec_id"] for r in a if r["seen"]) == list(range(0, 1000, 2))


def test_probes_bound_the_target(spark):
    a = seen.seen_before(spark.createDataFrame([(1, 1, 1, None, None)], SCHEMA), spark.createDataFrame([], KNOWN), target_fpp=1e-4)
    r = seen.error_rate(a, 1e-4).first()
    assert r["probes"] >= 30000 and r["upper_95"] <= 1e-4
