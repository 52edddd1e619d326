import random

from gaugeworks.llm.components import components


def test_chain_star_and_random_graph(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    got = dict(components(spark.createDataFrame([*edges, (5, 5), (None, 7)], "u long, v long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
