"""The solver and the analyses on small programs with known results, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from meetflow.functions.kinds import ExprKind as X
from meetflow.plans import analyses, link, views
from meetflow.plans.rounds import close_rows, close_values

FULL = (-(2**31), 2**31 - 1)
ASSIGN = "node int, var string, xkind int, a_var string, a_const long, b_var string, b_const long, weak boolean"
ENTRY = "node int, var string, lo long, hi long"


def edges(spark, pairs):
    return spark.createDataFrame([(s, d, 0) for s, d in pairs], "src int, dst int, label int")


def line(spark, n):
    return edges(spark, [(i, i + 1) for i in range(n - 1)])


def rows(d, *names):
    return sorted(tuple(r[n] for n in names) for r in d.collect())


def ranges_at(d, node):
    return {r["var"]: (r["lo"], r["hi"]) for r in d.where(F.col("node") == node).collect()}


def interval(spark, assigns, e, entry=(), **kw):
    return analyses.interval(spark.createDataFrame(assigns, ASSIGN), e, entry=spark.createDataFrame(list(entry), ENTRY), full=FULL, **kw)


def test_assign_and_return_liveness(spark):
    """x = 20; return x."""
    eff = spark.createDataFrame([(0, "x", None, False), (1, None, "x", True)], "node int, target string, source string, always boolean")
    assert rows(analyses.strong_liveness(eff, line(spark, 2)), "node", "var") == [(1, "x")]


def test_strong_liveness_kinds(spark):
    """a = b; c = d; use a; kill everything, use z; exit has g live."""
    eff = [(0, "a", "b", False), (1, "c", "d", False), (2, None, "a", True), (3, "*", None, False), (3, None, "z", True), (4, "g", "h", False)]
    d = spark.createDataFrame(eff, "node int, target string, source string, always boolean")
    exit_live = spark.createDataFrame([(5, "g")], "node int, var string")
    got = rows(analyses.strong_liveness(d, line(spark, 6), exit_live=exit_live), "node", "var")
    assert got == [(0, "b"), (0, "z"), (1, "a"), (1, "z"), (2, "a"), (2, "z"), (3, "z"), (4, "h"), (5, "g")]


def test_block_liveness_matches_instructions(spark):
    """Composed blocks give what instruction edges give, on random graphs."""
    rng = random.Random(3)
    for trial in range(2):
        insn, uses, bb_e, insn_e, eff = [], [], [], [], []
        for b in range(6):
            insn += [("f", b, 10 * b + i) for i in range(4)]
            insn_e += [(10 * b + i, 10 * b + i + 1) for i in range(3)]
            for i in range(4):
                v, kind = rng.choice("xyz"), rng.randrange(3)
                if kind < 2:
                    uses.append(("f", b, 10 * b + i, v, kind == 1))
                    eff.append((10 * b + i, v if kind else None, None if kind else v, not kind))
        for b in range(6):
            for c in rng.sample(range(6), 2):
                bb_e.append(("f", b, c))
                insn_e.append((10 * b + 3, 10 * c))
        got = analyses.liveness(spark.createDataFrame(insn, "fn string, bb int, seq int"), spark.createDataFrame(uses, "fn string, bb int, seq int, var string, is_def boolean"),
                                spark.createDataFrame(bb_e, "fn string, src int, dst int"), ["fn"])
        want = analyses.strong_liveness(spark.createDataFrame(eff, "node int, target string, source string, always boolean"), edges(spark, insn_e))
        assert rows(got, "seq", "var") == rows(want, "node", "var")


def test_reach(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5), (3, 6)])
    start = lambda n: spark.createDataFrame([(n,)], "node int")
    assert rows(analyses.reach(e, start(1)), "node") == [(1,), (2,), (3,), (6,)]
    assert rows(analyses.reach(e, start(6), backward=True), "node") == [(1,), (2,), (3,), (6,)]
    assert rows(analyses.reach(e, start(1), through=start(2)), "node") == [(1,), (2,)]
    assert rows(views.barrier(e, start(3)), "src", "dst") == [(1, 2), (2, 3), (4, 5)]


def test_interval_of_a_constant(spark):
    d = interval(spark, [(0, "x", int(X.VAL), None, 20, None, None, False)], line(spark, 2))
    assert ranges_at(d, 0) == ranges_at(d, 1) == {"x": (20, 20)}


def test_interval_loop_widens(spark):
    """x = 0; while (...) x = x + 1: the loop head widens, a variable beside it stays."""
    a = [(0, "x", int(X.VAL), None, 0, None, None, False), (0, "y", int(X.VAL), None, 7, None, None, False), (2, "x", int(X.ADD), "x", None, None, 1, False)]
    d = interval(spark, a, edges(spark, [(0, 1), (1, 2), (2, 1), (1, 3)]), widen_after=3)
    assert ranges_at(d, 3) == {"x": FULL, "y": (7, 7)}


def test_interval_operators(spark):
    a = [(0, "x", int(X.MUL), "a", None, "b", None, False), (0, "y", int(X.SUB), "a", None, "b", None, False), (0, "z", int(X.LT), "a", None, "b", None, False),
         (0, "n", int(X.NEGATE), "a", None, None, None, False), (0, "o", int(X.ADD), "a", None, None, 2**31 - 1, False), (0, "t", int(X.ADD), "top", None, None, 1, False)]
    d = interval(spark, a, line(spark, 2), [(0, "a", -2, 3), (0, "b", -5, 4)])
    got = ranges_at(d, 1)
    assert {k: got[k] for k in "xyzno"} == {"x": (-15, 12), "y": (-6, 8), "z": (0, 1), "n": (-3, 2), "o": FULL} and "t" not in got


def test_branches_meet_and_refine(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 0), (2, 3, 0)], "src int, dst int, label int")
    a = [(0, "x", int(X.VAL), None, 5, None, None, False), (1, "x", int(X.VAL), None, 9, None, None, False)]
    assert ranges_at(interval(spark, a, e), 3) == {"x": (5, 9)}
    cut = views.condition(e, spark.createDataFrame([(0, 0)], "src int, value int"), ["src"])
    assert ranges_at(interval(spark, a, cut, reached=analyses.reach(cut, spark.createDataFrame([(0,)], "node int"))), 3) == {"x": (5, 5)}


def test_pointer_arithmetic(spark):
    """p1 = &x; p2 = p1 + x."""
    d = analyses.points_to(spark.createDataFrame([("p1", "x")], "p string, x string"), spark.createDataFrame([("p2", "p1")], "p string, q string"))
    assert rows(d, "p", "x") == [("p1", "x"), ("p2", "x")]


def test_loads_and_stores(spark):
    """p = &a; q = &b; *p = q; r = *p; *r = p."""
    f = lambda r, s: spark.createDataFrame(r, s)
    d = analyses.points_to(f([("p", "a"), ("q", "b")], "p string, x string"), f([], "p string, q string"), f([("r", "p")], "p string, q string"), f([("p", "q"), ("r", "p")], "p string, q string"))
    assert rows(d, "p", "x") == [("a", "b"), ("b", "a"), ("p", "a"), ("q", "b"), ("r", "b")]


def test_pointers_sharpen_ranges(spark):
    """a[0] = 11; p = a; p[1] = 22: a is (11, 22), and b, never written, is top."""
    pts = analyses.points_to(spark.createDataFrame([("p", "a")], "p string, x string"), spark.createDataFrame([], "p string, q string"))
    expr = "struct<xkind: int, op1: string, op2: string, args: array<string>>"
    store = spark.createDataFrame([(2, "p", (17, "p", "1", []))], f"node int, ptr string, expr1 {expr}")
    v = views.deref(store, pts.withColumnsRenamed({"p": "ptr", "x": "target"}).withColumn("node", F.lit(2)), ["node"], "ptr", "expr1").collect()
    assert [(r["expr1"]["op1"], r["must"]) for r in v] == [("a", True)]
    a = [(0, "a", int(X.VAL), None, 11, None, None, True), (2, v[0]["expr1"]["op1"], int(X.VAL), None, 22, None, None, True)]
    assert ranges_at(interval(spark, a, line(spark, 4)), 3) == {"a": (11, 22)}


def test_calls(spark):
    """main: a = 30; f(100); f(c): b = c; g(200); g(d): a = d.  After: a = 200, b = 100."""
    e = spark.createDataFrame([("main", 0, 1, 0), ("main", 1, 2, 0), ("f", 0, 1, 0), ("f", 1, 2, 0), ("g", 0, 1, 0)], "function string, src int, dst int, label int")
    calls = spark.createDataFrame([("main", 1, "f"), ("f", 1, "g"), ("f", 1, "printf")], "function string, node int, callee string")
    bounds = spark.createDataFrame([("main", 0, 2), ("f", 0, 2), ("g", 0, 1)], "function string, entry int, exit int")
    for depth in (0, 2):
        g, nodes = link.supergraph(e, calls, bounds, main="main", depth=depth)
        a = [("main", 0, "a", None, 30), ("main", 1, "c", None, 100), ("f", 0, "b", "c", None), ("f", 1, "d", None, 200), ("g", 0, "a", "d", None)]
        at = spark.createDataFrame(a, "function string, n int, var string, a_var string, a_const long").join(nodes.withColumnRenamed("node", "n"), ["function", "n"])
        at = at.select(F.col("id").alias("node"), "var", F.lit(1).alias("xkind"), "a_var", "a_const", F.lit(None).cast("string").alias("b_var"), F.lit(None).cast("long").alias("b_const"), F.lit(False).alias("weak"))
        main = nodes.where("function = 'main'")
        entry = main.where("node = 0").select(F.col("id").alias("node"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("var"), F.lit(10).cast("long").alias("lo"), F.lit(20).cast("long").alias("hi"))
        d = analyses.interval(at, g, entry=entry, full=FULL)
        end = main.where("node = 2").collect()[0]["id"]
        got = ranges_at(d, end)
        assert got["a"] == (200, 200) and got["b"] == (100, 100)
        assert nodes.select("function", "context").distinct().count() == 3


def test_function_pointers(spark):
    """f = c ? f1 : f2; b = f(10) with f1: a = c * 2, f2: a = c * 3."""
    calls = spark.createDataFrame([("main", None, "f"), ("main", "g", None)], "caller string, callee string, pointer string")
    taken = spark.createDataFrame([("f", "f1"), ("f", "f2")], "pointer string, callee string")
    assert rows(link.call_graph(calls, taken), "caller", "callee") == [("main", "f1"), ("main", "f2"), ("main", "g")]
    e = spark.createDataFrame([("main", 0, 1, 0), ("f1", 0, 1, 0), ("f2", 0, 1, 0)], "function string, src int, dst int, label int")
    c = spark.createDataFrame([("main", 0, "f1"), ("main", 0, "f2")], "function string, node int, callee string")
    bounds = spark.createDataFrame([("main", 0, 1), ("f1", 0, 1), ("f2", 0, 1)], "function string, entry int, exit int")
    g, _ = link.supergraph(e, c, bounds, main="main")
    a = [("main@#0", "c", 1, None, 10, None, None, False), ("f1@#0", "a", 4, "c", None, None, 2, False), ("f2@#0", "a", 4, "c", None, None, 3, False)]
    d = analyses.interval(spark.createDataFrame(a, ASSIGN.replace("node int", "node string")), g, entry=spark.createDataFrame([], ENTRY.replace("node int", "node string")), full=FULL)
    assert ranges_at(d, "main@#1")["a"] == (20, 30)


def test_views(spark):
    expr = "struct<xkind: int, op1: string, op2: string, args: array<string>>"
    i = spark.createDataFrame([(1, "y", (1, "y", None, [])), (2, "z", (17, "a", "i", []))], f"node int, v string, expr2 {expr}")
    known = spark.createDataFrame([("y", "5"), ("y", "6"), ("z", "0")], "v string, literal string")
    got = views.literal_rhs(i, known, ["v"]).orderBy("node", "literal").collect()
    assert [(r["node"], r["expr2"]["op1"], r["expr2"]["xkind"]) for r in got] == [(1, "5", 1), (1, "6", 1), (2, "0", 1)]
    got = views.literal_index(i, known, ["v"], "expr2").collect()
    assert [(r["node"], r["expr2"]["op1"], r["expr2"]["op2"]) for r in got] == [(2, "a", "0")]
    a = spark.createDataFrame([(1, "x", 7), (2, "y", 7), (3, "y", 9)], "node int, t string, ikind int")
    live = spark.createDataFrame([(1, "x")], "node int, var string")
    assert [r["ikind"] for r in views.dead_assign(a, live, ["node"], "t").orderBy("node").collect()] == [7, 6, 9]
    e = edges(spark, [(1, 2), (2, 3)])
    assert rows(views.cascade(e, spark.createDataFrame([(1,), (2,)], "node int")), "src", "dst") == [(1, 2)]


def test_link(spark):
    f = lambda r: spark.createDataFrame(r, "name string, defined boolean, body string")
    got = link.link([f([("f", False, "decl"), ("g", True, "g1")]), f([("f", True, "f2"), ("g", True, "g2")])], "name", "defined")
    assert rows(got, "name", "body", "unit") == [("f", "f2", 1), ("g", "g1", 0)]
    calls = spark.createDataFrame([("m", 1, [5, 6]), ("m", 2, [])], "fn string, seq int, args array<int>")
    assert rows(link.call_arguments(calls, ["fn", "seq"]), "seq", "site", "pos", "arg") == [(1, 1, 0, 5), (1, 1, 1, 6)]


def test_no_partial_results(spark):
    seed = spark.createDataFrame([(0,)], "node int")
    with pytest.raises(RuntimeError, match="no fixed point"):
        close_rows(seed, lambda d: d.select((F.col("node") + 1).alias("node")), most_rounds=3)
    with pytest.raises(RuntimeError, match="no fixed point"):
        close_values(seed.withColumn("v", F.lit(0)), ["node"], ["v"], [F.max("v").alias("v")], lambda f, c: f.withColumn("v", F.col("v") + 1), most_rounds=3)
