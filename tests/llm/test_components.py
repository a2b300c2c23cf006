import random

from cloakframe.llm.components import connected_components


def brute(links):
    parent = {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        for x in (a, b):
            parent.setdefault(x, x)
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in parent}


def test_brute_force(spark):
    """Chains, stars, loops and repeated links, in one task and in many."""
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(rng.randint(1000, 1120), rng.randint(1000, 1120)) for _ in range(70)]
    links += links[:9] + [(b, a) for a, b in links[60:80]]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    # A node that only links to itself is left out.
    want = {i: c for i, c in brute(links).items() if any(i in x and x[0] != x[1] for x in links)}
    for task_links in (None, 20):
        assert {r.node: r.component for r in connected_components(df, task_links).collect()} == want
    assert connected_components(df.where("1 = 0")).count() == 0
