"""Dominators, frontiers and phi places against sets of nodes on all ways."""

import random

import pytest

from meetflow.plans import dominance


def reached(edges, start, without=None):
    seen, todo = set(), [start]
    while todo:
        a = todo.pop()
        if a in seen or a == without:
            continue
        seen.add(a)
        todo += [y for x, y in edges if x == a]
    return seen


def brute(edges, start, defs):
    nodes = reached(edges, start)
    dom = {n: {n} for n in nodes}
    for d in nodes:
        for n in nodes - reached(edges, start, without=d):
            dom[n].add(d)
    idom = {n: max(dom[n] - {n}, key=lambda d: len(dom[d])) for n in nodes if n != start}
    front = {(d, n) for p, n in edges if p in nodes for d in dom[p] if d == n or d not in dom[n]}
    phi = set()
    while True:
        more = {(v, j) for v, n in defs | phi for x, j in front if x == n} - phi
        if not more:
            return idom, front, phi
        phi |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_dominance(spark, seed):
    """Random graphs, chains with cross edges, self-loops, loops through the entry, nodes out of reach; functions share node numbers."""
    rng, edges, defs = random.Random(seed), {}, {}
    for f in range(12):
        n = rng.randint(1, 14)
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))}
        e |= {(i, i + 1) for i in range(n - 1) if f % 3 == 0 or rng.random() < 0.5}
        edges[f] = e | ({(3, 0), (50, 2), (51, 50)} if f % 4 == 1 else set())
        defs[f] = {(rng.choice("xy"), rng.randrange(n)) for _ in range(4)} & {(v, k) for v in "xy" for k in reached(edges[f], 0)}
    e = spark.createDataFrame([(f, a, b) for f, x in edges.items() for a, b in x], "fn int, src int, dst int")
    e = e.unionByName(e.limit(9))  # repeated edges
    entry = spark.createDataFrame([(f, 0) for f in edges], "fn int, node int")
    d = spark.createDataFrame([(f, v, k) for f, x in defs.items() for v, k in x], "fn int, var string, node int")
    idom = dominance.dominators(e, entry, ["fn"])
    front = dominance.frontiers(e, idom, entry, ["fn"])
    phi = dominance.phi_places(d, front, ["fn"])
    want = {f: brute(edges[f], 0, defs[f]) for f in edges}
    assert sorted(map(tuple, idom.collect())) == sorted((f, n, i) for f, w in want.items() for n, i in w[0].items())
    assert sorted(map(tuple, front.collect())) == sorted((f, *x) for f, w in want.items() for x in w[1])
    assert sorted(map(tuple, phi.collect())) == sorted((f, *x) for f, w in want.items() for x in w[2])


def test_dominance_of_one_graph_and_of_none(spark):
    """Without function columns: two nested loops; and empty tables."""
    edges = {(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (4, 5)}
    e, entry = spark.createDataFrame(sorted(edges), "src int, dst int"), spark.createDataFrame([(0,)], "node int")
    idom = dominance.dominators(e, entry)
    front = dominance.frontiers(e, idom, entry)
    want = brute(edges, 0, set())
    assert dict(map(tuple, idom.collect())) == want[0] and set(map(tuple, front.collect())) == want[1]
    none = e.where("false")
    assert dominance.dominators(none, entry).count() == 0
    idom = dominance.dominators(none, entry.where("false"))
    assert idom.count() == 0 and dominance.frontiers(none, idom, entry.where("false")).count() == 0
