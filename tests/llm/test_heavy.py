from collections import Counter

import numpy as np

from strandwise.llm import heavy

SCHEMA = "rec_id long, h long, l long, abundance long, chunk_id long, chunk_row int, total long"
KEY = ["h", "l"]


def run(spark, rows, inverse=10, **kw):
    once = heavy.delivered_once(spark.createDataFrame(rows, SCHEMA), KEY, "abundance", ["chunk_id", "chunk_row"])
    return {(r["h"], r["l"]): (r["estimate"], r["total"]) for r in heavy.iceberg(once, KEY, "abundance", inverse, **kw).collect()}


def test_counts_deliveries_once_and_skips_what_does_not_count(spark):
    rows = [
        (1, 1, 1, 5, 0, 0, 9), (2, 1, 1, 5, 0, 0, 9), (3, 1, 1, 4, 0, 1, 9), (4, 2, 2, 1, 0, 2, 9), (5, None, 2, 100, 0, 3, 9),
        (6, 2, None, 100, 0, 4, 9), (7, 3, 3, heavy.UNKNOWN_COUNT, 0, 5, 9), (8, 3, 3, None, 0, 6, 9), (9, 4, 4, 1, None, None, None),
    ]
    got = run(spark, rows, 11)
    assert {k: t for k, (_, t) in got.items()} == {(1, 1): 9, (2, 2): 1, (4, 4): 1}


def test_records_of_no_known_delivery_count_by_themselves(spark):
    rows = [(i, 1, 1, 2, None, i, 0) for i in range(3)] + [(9, 2, 2, 2, 1, None, 0), (10, 2, 2, 2, 1, None, 0), (11, 3, 3, 1, 1, 1, 0), (12, 3, 3, 1, 1, 1, 0)]
    assert {k: t for k, (_, t) in run(spark, rows, 100).items()} == {(1, 1): 6, (2, 2): 4, (3, 3): 1}


def test_threshold_is_met_exactly(spark):
    rows = [(i, 1, 1, 1, 0, i, None) for i in range(10)] + [(99, i, i, 1, 1, i, None) for i in range(2, 92)]
    assert set(run(spark, rows, 10)) == {(1, 1)}
    assert set(run(spark, rows, 9)) == set()


def test_against_exact_counts_with_colliding_buckets(spark):
    rng = np.random.default_rng(0)
    keys = np.where(rng.random(5000) < 0.33, 0, rng.zipf(1.5, 5000) % 900)
    rows = [(i, int(k), int(k) % 5, int(rng.integers(0, 9)), 0, i, None) for i, k in enumerate(keys)]
    exact = Counter()
    for _, h, l, a, *_ in rows:
        exact[h, l] += a
    total = sum(exact.values())
    want = {k: n for k, n in exact.items() if n * 50 >= total}
    got = run(spark, rows, 50, hashes=2, buckets=64)
    assert {k: t for k, (_, t) in got.items()} == want
    assert all(e >= t for e, t in got.values())


def test_empty_and_weightless(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1, 1, 0, 0, 0, None)]) == {}
