"""Strong components of graphs of many groups: rounds must not follow the length of their chains."""

import random

from codeloom.operators import graph, rounds


def test_many_groups_are_walked_without_rounds(spark, monkeypatch):
    names = []
    real = rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name: names.append(name) or real(df, name))
    # six chains of 40 files, each with a circle at its end; no chain has 100 edges, all have
    pairs = [(f"g{g}n{i:02}", f"g{g}n{i + 1:02}") for g in range(6) for i in range(39)] + [(f"g{g}n39", f"g{g}n37") for g in range(6)] + [("g0n05", "g0n05")]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(pairs, "source string, target string"), 100).collect()}
    assert got == {f"g{g}n{i}": f"g{g}n37" for g in range(6) for i in (37, 38, 39)} | {"g0n05": "g0n05"}
    # one table for each halving of the chains and not one for each of their files
    assert len(names) < 40 and names.count("colours") == names.count("members") == 0


def test_groups_of_every_size(spark):
    rnd = random.Random(8)
    pairs = {(f"{g}.{rnd.randrange(g)}", f"{g}.{rnd.randrange(g)}") for g in range(1, 14) for _ in range(g + 2)}
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(14):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {}
    for x in reach:
        own = {y for y in reach[x] if x in reach[y]}
        if len(own) > 1 or (x, x) in pairs:
            want[x] = min(own)
    # some groups are walked, larger ones go by rounds
    got = [tuple(r) for r in graph.strong_components(spark.createDataFrame(sorted(pairs), "source string, target string"), 9).select("node", "component").collect()]
    assert len(got) == len(set(got)) and dict(got) == want


def test_groups_over_several_batches():
    pd = graph.pd
    rows = [("a", "a1", "a2"), ("a", "a2", "a1"), ("b", "b1", "b2"), ("b", "b2", "b3"), ("b", "b3", "b1"), ("c", "c1", "c2"), ("d", "d1", "d2"), ("d", "d2", "d1")]
    want = [("a1", "a1"), ("a2", "a1"), ("b1", "b1"), ("b2", "b1"), ("b3", "b1"), ("d1", "d1"), ("d2", "d1")]
    for size in range(1, 9):
        frames = [pd.DataFrame(rows[i : i + size], columns=["root", "source", "target"]) for i in range(0, 8, size)]
        assert sorted(tuple(r) for f in graph._strong_by_group(iter(frames)) for r in f.itertuples(index=False)) == want
