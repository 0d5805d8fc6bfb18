"""Reachability over long chains, and ranges of counted loops."""

import random

import pytest

from meetflow.plans import analyses


def walked(edges, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return sorted(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_contracted_reach(spark, seed):
    """Chains, trees, cycles that nothing leads to, ladders, self-loops; by function."""
    rng, rows, starts = random.Random(seed), [], []
    for f in range(4):
        n = 40
        e = [(i, i + 1) for i in range(n) if rng.random() < 0.9] + [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12))] + [(100, 101), (101, 102), (102, 100), (102, 5 * f)] + [(7, 7)]
        rows += [(f, a, b) for a, b in e]
        starts += [(f, s) for s in rng.sample(range(n), 2)]
    e, s = spark.createDataFrame(rows, "fn int, src int, dst int"), spark.createDataFrame(starts, "fn int, node int")
    got = sorted(map(tuple, analyses.reach_contracted(e, s, ["fn"]).collect()))
    assert got == sorted((f, x) for f in range(4) for x in walked([(a, b) for g, a, b in rows if g == f], [x for g, x in starts if g == f]))


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """A chain of 100,000 nodes takes fewer than 25 rounds."""
    from meetflow.plans import rounds

    jobs, put = [], rounds.Tables.put
    monkeypatch.setattr(rounds.Tables, "put", lambda self, df, *a: jobs.append(1) or put(self, df, *a))
    e = spark.range(100_000).selectExpr("id as src", "id + 1 as dst")
    assert analyses.reach_contracted(e, spark.createDataFrame([(0,)], "node long")).count() == 100_001
    assert len(jobs) < 35  # eighteen jumps, the rest tables that are read again


def loops(spark, cases):
    """x = 0; while (x < limit) x += step; y = x; a function each; with the limit in a variable n where it is a pair of bounds; GE: while not (x >= limit)."""
    from meetflow.functions.kinds import ExprKind as X
    from meetflow.operators import graph

    assigns, edges, entry = [], [], []
    for f, (step, limit, kind) in cases.items():
        var = isinstance(limit, tuple)
        n = ("n", None) if var else (None, limit)
        assigns += [(f, 0, "x", int(X.VAL), None, 0, None, None, False), (f, 1, "t", int(X[kind]), "x", None, *n, False), (f, 3, "x", int(X.ADD), "x", None, None, step, False), (f, 4, "y", int(X.VAL), "x", None, None, None, False)]
        yes, no = (2, 1) if kind == "GE" else (1, 2)
        edges += [(f, 0, 1, 0), (f, 1, 2, 0), (f, 2, 3, yes), (f, 3, 1, 0), (f, 2, 4, no)]
        entry += [(f, 0, "n", *limit)] if var else []
    a = spark.createDataFrame(assigns, "f string, node int, var string, xkind int, a_var string, a_const long, b_var string, b_const long, weak boolean")
    e = spark.createDataFrame(edges, "f string, src int, dst int, label int")
    conditions = analyses.comparisons(spark.createDataFrame([(f, 2, "t") for f in cases], "f string, node int, var string"), a, e, ["f"])
    assert conditions.count() == len(cases)
    entry = spark.createDataFrame(entry, "f string, node int, var string, lo long, hi long")
    got = analyses.interval(a, e, ["f"], entry=entry, full=(-(2**31), 2**31 - 1), refine=analyses.branch_limits(conditions, ["f"]), heads=graph.loop_heads(e, ["f"]), widen_after=2, narrow=8)
    return {(r["f"], r["node"], r["var"]): (r["lo"], r["hi"]) for r in got.collect()}


def test_counted_loops(spark):
    """The bound of a counted loop is exact, by a constant, by a variable, by the false side of x >= n."""
    got = loops(spark, {"f": (1, 10, "LT"), "g": (3, (5, 20), "LT"), "h": (1, 7, "GE")})
    assert (got["f", 1, "x"], got["f", 3, "x"], got["f", 4, "y"], got["f", 1, "t"]) == ((0, 10), (1, 10), (10, 10), (0, 1))
    assert (got["g", 1, "x"], got["g", 3, "x"], got["g", 4, "y"], got["g", 4, "n"]) == ((0, 22), (3, 22), (5, 22), (5, 20))
    assert (got["h", 1, "x"], got["h", 4, "y"]) == ((0, 7), (7, 7))
