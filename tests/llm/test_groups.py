import random

from strandwise.llm import groups


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "x long, y long, a string, node int") if pairs and len(pairs[0]) == 4 else spark.createDataFrame([(*p, "z", 1) for p in pairs], "x long, y long, a string, node int")
    every = groups.links([(df.select("x", "y"), "x", "y")])
    return {tuple(r) for r in groups.connected_groups(every).collect()}


def test_random_graph_with_a_hub_and_a_long_path(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(120)]
    pairs += [(5000, 5001 + i) for i in range(150)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2040 - i, 2039 - i) for i in range(30)]
    pairs += [(7, 7), (9000, 9000)] + pairs[:10] + [(b, a) for a, b in pairs[:10]]
    assert run(spark, pairs) == brute(pairs)


def test_nulls_unset_and_empty(spark):
    pairs = [(None, 1), (1, None), (groups.UNSET, 2), (3, groups.UNSET), (4, 5)]
    assert run(spark, pairs) == {(4, 4), (5, 4)}
    assert run(spark, [(None, None)]) == set()
    assert run(spark, [(8, 8)]) == {(8, 8)}
