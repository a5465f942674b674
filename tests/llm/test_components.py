import random

from fillwise.llm.components import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_chains_stars_and_random_links(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(400, 480)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)]
    edges += [(3, 3), (7, 5), (5, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: c for x, c in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
