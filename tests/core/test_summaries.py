"""Facts across calls against calls inlined by hand."""

import random

import pytest

from meetflow.plans import summaries


def frames(spark, p):
    cols = {"edges": "function string, src int, dst int", "bounds": "function string, entry int, exit int", "moves": "function string, node int, target string, source string, object string",
            "calls": "function string, node int, callee string", "args": "function string, node int, param string, arg string", "results": "function string, node int, target string, result string"}
    return summaries.Program(**{k: spark.createDataFrame(p[k], c) for k, c in cols.items()})


def inlined(p, function, facts, depth):
    """Facts before each node of a function that begins with ``facts`` {(var, object)}, calls inlined to a depth: {node: facts}."""
    entry, exit_ = {f: (a, b) for f, a, b in p["bounds"]}[function]
    before = {entry: set(facts)}
    while True:
        old = {n: set(s) for n, s in before.items()}
        for n, here in old.items():
            out, killed = set(), set()
            for f, m, target, source, obj in p["moves"]:
                if (f, m) == (function, n):
                    killed.add(target)
                    out |= {(target, o) for v, o in here if v == source} | ({(target, obj)} if obj else set())
            for f, m, callee in p["calls"]:
                if (f, m) == (function, n):
                    results = [(t, r) for g, k, t, r in p["results"] if (g, k) == (function, n)]
                    killed |= {t for t, _ in results}
                    if callee in {b[0] for b in p["bounds"]} and depth:
                        given = {(q, o) for g, k, q, a in p["args"] if (g, k) == (function, n) for v, o in here if v == a}
                        end = inlined(p, callee, given, depth - 1).get({b[0]: b[2] for b in p["bounds"]}[callee], set())
                        out |= {(t, o) for t, r in results for v, o in end if v == r}
            out |= {(v, o) for v, o in here if v not in killed}
            for f, a, b in p["edges"]:
                if (f, a) == (function, n):
                    before.setdefault(b, set()).update(out)
        if before == old:
            return before


def collected(p, function, facts, depth, out):
    """Facts before all nodes of all inlined calls, by function."""
    here = inlined(p, function, facts, depth)
    for n, s in here.items():
        out.setdefault((function, n), set()).update(s)
    for f, m, callee in p["calls"]:
        if f == function and m in here and depth and callee in {b[0] for b in p["bounds"]}:
            collected(p, callee, {(q, o) for g, k, q, a in p["args"] if (g, k) == (f, m) for v, o in here[m] if v == a}, depth - 1, out)


def check(spark, p, depth):
    out = {}
    collected(p, "main", {("a", "start")}, depth, out)
    want = {(f, n, v, o) for (f, n), s in out.items() for v, o in s}
    start = spark.createDataFrame([("main", "a", "start")], "function string, param string, object string")
    got = {tuple(r) for r in summaries.points_to_across_calls(frames(spark, p), start).collect()}
    reached = {(f, n) for f, n in out}
    assert {g for g in got if (g[0], g[1]) in reached} == want
    return want


def test_two_levels_and_recursion(spark):
    """main: x = &o; y = id(x); z = id(&p); swap(...) recursive: what id gives back goes to its own caller only."""
    p = {
        "bounds": [("main", 0, 5), ("id", 0, 2), ("deep", 0, 1), ("turn", 0, 3)],
        "edges": [("main", i, i + 1) for i in range(5)] + [("id", 0, 1), ("id", 1, 2), ("deep", 0, 1), ("turn", 0, 1), ("turn", 0, 3), ("turn", 1, 2), ("turn", 2, 3)],
        "moves": [("main", 0, "x", None, "o"), ("main", 1, "w", None, "p"), ("id", 0, "t", "a", None), ("deep", 0, "r", "a", None), ("turn", 2, "c", "d", None)],
        "calls": [("main", 2, "id"), ("main", 3, "id"), ("main", 4, "turn"), ("id", 1, "deep"), ("turn", 1, "turn"), ("id", 0, "unknown")],
        "args": [("main", 2, "a", "x"), ("main", 3, "a", "w"), ("main", 4, "c", "x"), ("main", 4, "d", "w"), ("id", 1, "a", "t"), ("turn", 1, "c", "d"), ("turn", 1, "d", "c")],
        "results": [("main", 2, "y", "r"), ("main", 3, "z", "r"), ("main", 4, "v", "c"), ("id", 1, "r", "r"), ("turn", 1, "d", "c")],
    }
    want = check(spark, p, 8)
    assert {o for f, n, v, o in want if (f, n, v) == ("main", 5, "y")} == {"o"} and {o for f, n, v, o in want if (f, n, v) == ("main", 5, "z")} == {"p"}
    assert {o for f, n, v, o in want if (f, n, v) == ("main", 5, "v")} == {"o", "p"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_programs(spark, seed):
    rng, names = random.Random(seed), ["main", "f", "g"]
    p = {"bounds": [(f, 0, 4) for f in names], "edges": [(f, i, i + 1) for f in names for i in range(4)], "moves": [], "calls": [], "args": [], "results": []}
    for f in names:
        p["edges"] += [(f, a, b) for a, b in [(rng.randint(0, 3), rng.randint(1, 4))]]
        for n in range(4):
            kind = rng.choice(["address", "copy", "other", "call", "call", "none"])
            x, y = rng.choice("abc"), rng.choice("abc")
            if kind in ("address", "copy", "other"):
                p["moves"].append((f, n, x, y if kind == "copy" else None, f"{f}{n}" if kind == "address" else None))
            if kind == "call":
                p["calls"].append((f, n, rng.choice(names[1:])))
                p["args"] += [(f, n, "a", x), (f, n, "b", y)]
                p["results"].append((f, n, rng.choice("abc"), "c"))
    check(spark, p, 7)
