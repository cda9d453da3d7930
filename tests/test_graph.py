import random

from lakeloom.operators.graph import connected_components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(40)] + [(500, x) for x in range(501, 540)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:5] + [(900, 900), (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
