import random

import pytest

from photolith.operators import dedupe, graph


def first_set(nodes, edges):
    """In order: a node is in unless a better neighbour is."""
    better = {}
    for x, y in edges:
        better.setdefault(y, set()).add(x)
    found = set()
    for n in sorted(nodes):
        if not better.get(n, set()) & found:
            found.add(n)
    return found


def made(seed, n, m):
    rng = random.Random(seed)
    names = [f"{k:05}" for k in range(n)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(m)}
    return names, sorted(edges)


def frames(spark, names, edges):
    return spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(edges, "better string, worse string")


def roots(edges):
    top = {}

    def find(a):
        while top.setdefault(a, a) != a:
            a = top[a]
        return a

    for x, y in edges:
        top[find(x)] = find(y)
    return {a: find(a) for a in top}


@pytest.mark.parametrize("seed, n, m", [(1, 200, 90), (2, 60, 400), (3, 300, 300)])
def test_components(spark, seed, n, m):
    _, edges = made(seed, n, m)
    found, rounds = graph.components(spark.createDataFrame([*edges, ("x", "x")], "a string, b string"))
    got, want = {r.node: r.root for r in found.collect()}, roots(edges)
    assert got.keys() == want.keys() and rounds <= 10
    assert len({(got[a], want[a]) for a in want}) == len(set(got.values())) == len(set(want.values()))


def test_a_long_chain_takes_few_rounds(spark):
    chain = [(f"{k:05}", f"{k + 1:05}") for k in range(999)]
    found, rounds = graph.components(spark.createDataFrame(chain, "a string, b string"))
    assert found.count() == 1000 and found.select("root").distinct().count() == 1 and rounds <= 15


def test_components_without_edges(spark):
    found, rounds = graph.components(spark.createDataFrame([], "a string, b string"))
    assert found.columns == ["node", "root"] and found.count() == 0 and rounds == 0


@pytest.mark.parametrize("limit", [10**6, 60, 2])
def test_the_first_independent_set_however_it_is_found(spark, monkeypatch, limit):
    monkeypatch.setattr(dedupe, "EDGES", limit)
    for seed, n, m in ((4, 150, 120), (5, 40, 200)):
        names, edges = made(seed, n, m)
        found = dedupe.independent(*frames(spark, names, edges)).collect()
        assert sorted(r.node for r in found) == sorted(first_set(names, edges))


def test_a_chain_of_a_thousand(spark, monkeypatch):
    names = [f"{k:05}" for k in range(1000)]
    edges = list(zip(names, names[1:]))
    want = names[::2]
    assert sorted(r.node for r in dedupe.independent(*frames(spark, names, edges)).collect()) == want
    monkeypatch.setattr(dedupe, "EDGES", 998)
    calls = []
    monkeypatch.setattr(dedupe, "_by_rounds", lambda nodes, edges: calls.append(1) or nodes)
    more = [(f"z{k}", f"z{k + 1}") for k in range(3)]
    monkeypatch.setattr(dedupe, "EDGES", 999)
    found = dedupe.independent(*frames(spark, [*names, "z0", "z1", "z2", "z3"], edges + more)).collect()
    assert sorted(r.node for r in found) == [*want, "z0", "z2"] and not calls


def test_nothing_to_decide(spark):
    nodes, edges = frames(spark, ["a", "b"], [("x", "y")])
    assert sorted(r.node for r in dedupe.independent(nodes, edges.limit(0)).collect()) == ["a", "b"]
    assert dedupe.independent(nodes.limit(0), edges.limit(0)).count() == 0
