"""Ranges and pointer targets that simplify instructions for each other."""

import random

import pytest

from meetflow.functions.kinds import EdgeLabel
from meetflow.functions.kinds import ExprKind as X
from meetflow.plans.cooperation import CALLS, cooperate
from meetflow.plans.framework import Solver
from meetflow.product_queries import Mirror

FULL = (-(2**31), 2**31 - 1)
T, N = int(EdgeLabel.TRUE), int(EdgeLabel.FALSE)
INSN = "fn string, node int, op string, x bigint, a_var bigint, a_const bigint, b_var bigint, b_const bigint, xkind int"


def assign(node, x, a=None, c=None, b=None, d=None, kind=X.VAL):
    return node, "assign", x, a, c, b, d, int(kind)


def op(node, name, x=None, a=None, c=None):
    return node, name, x, a, c, None, None, None


def solve(spark, programs, views=("deref", "condition")):
    """programs: name -> (instructions, edges, entry, arrays), solved together; results by name."""
    rows = [[(name, *r) for name, p in programs.items() for r in (p[part] if len(p) > part else [])] for part in range(3)]
    i = spark.createDataFrame(rows[0], INSN)
    e = spark.createDataFrame([r if len(r) == 4 else (*r, 0) for r in rows[1]], "fn string, src int, dst int, label int")
    held = spark.createDataFrame(rows[2], "fn string, var bigint, target bigint, lo bigint, hi bigint")
    arrays = spark.createDataFrame([(name, v) for name, p in programs.items() for v in (p[3] if len(p) > 3 else [])], "fn string, var bigint")
    ends = spark.createDataFrame([(name, 0) for name in programs], "fn string, node int")
    got = cooperate(i, held, e, ends, ["fn"], full=FULL, views=views, many=arrays).collect()
    out = {name: (set(), {}, {}) for name in programs}
    for r in got:
        reached, ranges, targets = out[r["fn"]]
        if r["domain"] == "reach":
            reached.add(r["node"])
        elif r["domain"] == "range":
            ranges[r["node"], r["var"]] = (r["lo"], r["hi"])
        else:
            targets.setdefault((r["node"], r["var"]), set()).add(r["target"])
    assert len(got) == sum(len(a) + len(b) + sum(map(len, c.values())) for a, b, c in out.values())
    return out


def in_a_row(n):
    return [(i, i + 1) for i in range(n)]


def array_pointer():
    """char a[10], *b = a; *(b++) = 1."""
    a, b, t = 0, 1, 2
    insn = [op(0, "addr", b, a), assign(1, t, b), assign(2, b, b, None, None, 1, X.ADD), op(3, "store", t, None, 1), op(4, "load", 5, t)]
    return insn, in_a_row(5), [], [a]


def function_pointers():
    """b = f(f1) + f(f2) with f(ff) calling ff and f1, f2 returning 0 and 100; every call has its own copies."""
    b, r, ff, one, two, f1, f2 = 0, 1, 2, 3, 4, 10, 20
    insn, edges = [assign(0, b, None, 10)], [(0, 1)]
    for n, (value, f) in enumerate([(one, f1), (two, f2)]):
        at = 1 + 10 * n
        insn += [op(at, "addr", ff, f), op(at + 1, "invoke", None, ff), assign(at + 3, r, None, 0), assign(at + 4, r, None, 100), assign(at + 5, value, r)]
        edges += [(at, at + 1), (at + 1, at + 3, CALLS + f1), (at + 1, at + 4, CALLS + f2), (at + 3, at + 5), (at + 4, at + 5), (at + 5, at + 10 if not n else 30)]
    return [*insn, assign(30, b, one, None, two, None, X.ADD)], [*edges, (30, 31)]


def each_helps():
    """What is loaded through p is 0, so the side that would point p elsewhere is closed, so what is loaded later is exact."""
    a, b, x, p = 0, 1, 2, 3
    insn = [op(0, "addr", p, a), op(1, "load", x, p), op(2, "branch", None, x), op(3, "addr", p, b), op(4, "load", x, p)]
    return insn, [(0, 1), (1, 2), (2, 3, T), (2, 4, N), (3, 4), (4, 5)], [(a, None, 0, 0), (b, None, 7, 7)]


def pointer_stores():
    """pp = &p; *pp = q makes p point where q does."""
    a, b, p, q, pp = range(5)
    insn = [op(0, "addr", p, a), op(1, "addr", q, b), op(2, "addr", pp, p), op(3, "store", pp, q), op(4, "store", p, None, 9)]
    return insn, in_a_row(5), [(a, None, 1, 1), (b, None, 2, 2)]


#: x grows in a loop until it is anything; y does not.
LOOP = [assign(1, 0, 0, None, None, 1, X.ADD)], [(0, 1), (1, 1), (1, 2)], [(0, None, 0, 0), (1, None, 5, 5)]
NOWHERE = [op(0, "load", 2, 3), assign(1, 2, None, 1)], in_a_row(2), []


def test_all_views_and_random_programs(spark):
    """Small programs by what must hold, random ones against one node at a time in random order, all in one run."""
    rng = random.Random(1)
    randoms = {f"r{n}": random_program(rng) for n in range(40)}
    small = {"array": array_pointer(), "calls": function_pointers(), "each": each_helps(), "stores": pointer_stores(), "nowhere": NOWHERE, "empty": ([], [(0, 1)], []), "loop": LOOP}
    got = solve(spark, small | randoms)
    _, ranges, targets = got["array"]
    assert ranges[4, 0] == (1, 1) and targets[4, 1] == {0} and ranges[5, 5] == (1, 1)
    reached, ranges, _ = got["calls"]
    assert ranges[31, 0] == (100, 100) and 5 not in reached and 14 not in reached
    reached, ranges, targets = got["each"]
    assert reached == {0, 1, 2, 4, 5} and ranges[5, 2] == (0, 0) and targets[5, 3] == {0}
    _, ranges, targets = got["stores"]
    assert targets[5, 2] == {1} and ranges[5, 0] == (1, 1) and ranges[5, 1] == (9, 9)
    assert got["nowhere"][0] == {0} and got["empty"][0] == {0, 1}  # a pointer without targets is a barrier
    assert got["loop"][1][2, 0] == FULL and got["loop"][1][2, 1] == (5, 5)
    for name, (insn, edges, entry) in randoms.items():
        states = [brute(insn, edges, entry, s) for s in (1, 2)]
        assert states[0] == states[1]
        reached, ranges, targets = got[name]
        held = {n: s for n, s in states[0].items() if s is not None}
        assert reached == set(held), name
        assert ranges == {(n, v): r for n, s in held.items() for v, r in s[0].items()}, name
        assert targets == {(n, v): t for n, s in held.items() for v, t in s[1].items() if t}, name


def test_fewer_views(spark):
    """Without targets loads, stores and calls are anything; without conditions both sides are possible."""
    none = solve(spark, {"calls": function_pointers(), "stores": pointer_stores()}, ())
    assert none["calls"][1][31, 0] == (0, 200) and {4, 5, 14, 15} <= none["calls"][0]
    assert none["stores"][1][5, 0] == none["stores"][1][5, 1] == FULL
    reached, ranges, targets = solve(spark, {"each": each_helps()}, ["deref"])["each"]
    assert 3 in reached and ranges[5, 2] == (0, 7) and targets[5, 3] == {0, 1}
    with pytest.raises(ValueError):
        solve(spark, {"each": each_helps()}, ["dead"])


def random_program(rng):
    """Ten nodes without cycles: assignments, addresses, loads, stores, branches over five variables."""
    insn, edges, v = [], [], lambda: rng.randrange(5)
    for n in range(9):
        kind = rng.choice(["assign", "assign", "addr", "load", "store", "store", "branch"])
        if kind == "assign":
            k = rng.choice([X.VAL, X.ADD, X.SUB])
            insn.append((n, "assign", v(), v(), None, None if k == X.VAL else v(), None, int(k)))
        elif kind == "store" and rng.random() < 0.5:
            insn.append(op(n, "store", v(), None, rng.randrange(3)))
        else:
            insn.append(op(n, kind, None if kind == "branch" else v(), v()))
        edges += [(n, n + 1, T), (n, min(9, n + rng.randrange(2, 4)), N)] if kind == "branch" else [(n, n + 1, 0)]
    return insn, edges, [(x, None, 0, rng.randrange(2)) for x in range(5)] + [(x, rng.randrange(5), None, None) for x in range(5) if rng.random() < 0.7]


def brute(insn, edges, entry, seed):
    """Least solution by one node at a time in random order, over states of plain dicts."""
    rng, by = random.Random(seed), {r[0]: r for r in insn}
    nodes = {0} | {e[0] for e in edges} | {e[1] for e in edges}
    into = {n: None for n in nodes}

    def hull(s, v, r):
        old = s[0].get(v)
        s[0][v] = r if old is None else (min(old[0], r[0]), max(old[1], r[1]))

    def after(n):
        """(label, state) pairs."""
        ranges, aims = dict(into[n][0]), {v: set(t) for v, t in into[n][1].items()}
        if n not in by:
            return [(None, (ranges, aims))]
        _, name, x, a, c, b, d, kind = by[n]
        value = lambda v, k: (k, k) if k is not None else into[n][0].get(v)
        if name == "branch":
            v, out = value(a, None), []
            if v and v != (0, 0):
                out.append((T, ({**ranges, a: (v[0] or 1, v[1] or -1)}, aims)))
            if v and v[0] <= 0 <= v[1]:
                out.append((N, ({**ranges, a: (0, 0)}, aims)))
            return out
        if name in ("load", "store"):
            to = into[n][1].get(a if name == "load" else x, set())
            if not to:
                return []
        if name in ("assign", "addr", "load"):
            ranges.pop(x, None), aims.pop(x, None)
        new = (ranges, aims)
        if name == "addr":
            aims[x] = {a}
        elif name == "load":
            for t in to:
                if t in into[n][0]:
                    hull(new, x, into[n][0][t])
                if into[n][1].get(t):
                    aims[x] = aims.get(x, set()) | into[n][1][t]
        elif name == "store":
            if len(to) == 1:
                ranges.pop(min(to), None), aims.pop(min(to), None)
            for t in to:
                if value(a, c):
                    hull(new, t, value(a, c))
                if a is not None and into[n][1].get(a):
                    aims[t] = aims.get(t, set()) | into[n][1][a]
        else:
            for v in (a, b):
                if v is not None and into[n][1].get(v) and kind in (int(X.VAL), int(X.ADD), int(X.SUB)):
                    aims[x] = aims.get(x, set()) | into[n][1][v]
            l, r = value(a, c), value(b, d)
            if kind == int(X.VAL) and l:
                ranges[x] = l
            elif l and r:
                ranges[x] = (l[0] + r[0], l[1] + r[1]) if kind == int(X.ADD) else (l[0] - r[1], l[1] - r[0])
        return [(None, new)]

    into[0] = ({v: (lo, hi) for v, t, lo, hi in entry if t is None}, {})
    for v, t, _, _ in entry:
        if t is not None:
            into[0][1].setdefault(v, set()).add(t)
    todo = {0}
    while todo:
        n = rng.choice(sorted(todo))
        todo.discard(n)
        for label, (ranges, aims) in after(n):
            for src, dst, kind in edges:
                if src != n or (label is not None and label != kind):
                    continue
                old = into[dst]
                new = ({}, {}) if old is None else (dict(old[0]), {v: set(t) for v, t in old[1].items()})
                for v, r in ranges.items():
                    hull(new, v, r)
                for v, t in aims.items():
                    new[1][v] = new[1].get(v, set()) | t
                if new != old:
                    into[dst] = new
                    todo.add(dst)
    return into


def test_replacing_differs_from_meeting(spark):
    """0 -> 1 -> 2 and 0 -> 2; node 1 adds 7, node 2 mirrors: the greater value comes later and makes a smaller one, which meeting hides."""
    c = spark.createDataFrame([("f", 0, 0, "view", 0), ("f", 0, 1, "signup", 7), ("f", 0, 2, "purchase", 0)], "fid string, chunk int, node int, t string, k bigint")
    e = spark.createDataFrame([("f", 0, a, b) for a, b in [(0, 1), (1, 2), (0, 2), (2, 3)]], "fid string, chunk int, src int, dst int")
    ends = c.where("node = 0").select("fid", "chunk", "node")
    got = [{r["node"]: r["v"] for r in Solver(Mirror(c), e, ends, ["fid", "chunk"], meet_at_blocks=m).run().where("point = 'IN'").collect()} for m in (False, True)]
    assert got[0] == {0: 0, 1: 0, 2: 7, 3: 93} and got[1] == {0: 0, 1: 0, 2: 7, 3: 100}
