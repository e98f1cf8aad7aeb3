import random

from codeloom.llm.components import components


def test_components_of_random_links(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(-60, 60), rnd.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(200, 230)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(root)
    assert {r.node: r.root for r in got} == {x: find(x) for x in root}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
