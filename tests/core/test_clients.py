"""Whole programs: built units, their tables, and the analyses' results."""

import pytest
from pyspark.sql import functions as F

from meetflow.functions import scalars as S
from meetflow.functions.kinds import ExprKind as X
from meetflow.functions.kinds import ValueKind as V
from meetflow.operators import types
from meetflow.plans import analyses, clients
from meetflow.sources.build import Unit, expr, value

FULL = (-(2**31), 2**31 - 1)
FN = ["tu_id", "fid"]


def line(insn):
    e = insn.select(*FN, F.col("seq").alias("src"), (F.col("seq") + 1).alias("dst"))
    return e.join(insn.select(*FN, F.col("seq").alias("dst")), [*FN, "dst"], "left_semi")


def ranges_after(spark, u, node):
    t = u.tables(spark)
    entry = spark.createDataFrame([], "tu_id bigint, fid bigint, node int, var bigint, lo bigint, hi bigint")
    d = analyses.interval(clients.interval_assigns(t["insn"], t["entity"]), line(t["insn"]), FN, entry=entry, full=FULL)
    names = {v: k for k, v in u.ids.items()}
    return {names[r["var"]]: (r["lo"], r["hi"]) for r in d.where(F.col("node") == node).collect()}


def live_before(spark, u):
    t = u.tables(spark)
    d = analyses.strong_liveness(clients.liveness_effects(t["insn"], t["entity"]), line(t["insn"]), FN)
    names = {v: k for k, v in u.ids.items()}
    return sorted((r["node"], names[r["var"]]) for r in d.collect())


def points(spark, u):
    t = u.tables(spark)
    c = clients.pointer_constraints(t["insn"], t["entity"])
    d = analyses.points_to(*[c[k].drop("tu_id") for k in ("address", "copy", "load", "store")])
    names = {v: k for k, v in u.ids.items()}
    return sorted((names[r["p"]], names[r["x"]]) for r in d.collect())


def test_first_program(spark):
    """x = 20; return x."""
    u = Unit("one.c")
    f = u.function("f:main")
    x = u.var("x", f)
    u.assign(f, value(x), value(u.const(20)))
    u.ret(f, x)
    assert live_before(spark, u) == [(1, "x")]
    assert ranges_after(spark, u, 1) == {"x": (20, 20)}


def test_liveness_of_all_kinds(spark):
    u = Unit("live.c")
    f = u.function("f:main")
    a, b, c, p, g = u.var("a", f), u.var("b", f), u.var("c", f), u.var("p", f, V.PTR_TO_INT), u.var("g")
    u.assign(f, value(a), expr(X.ADD, b, u.const(1)))  # dead: a is not live after
    u.assign(f, expr(X.DEREF, p), value(c))
    u.use(f, b, kill=True)
    u.assign(f, value(a), expr(X.CALL, f, None, [c]))
    u.self_assign(f, c)
    u.cond(f, a, u.label("x"), u.label("y"))
    u.call(f, f, b)
    u.ret(f)
    got = {}
    for n, v in live_before(spark, u):
        got.setdefault(n, set()).add(v)
    assert got[6] == {"b", "g"} and got[5] == {"a", "b", "g"} and got[4] == {"a", "b", "g"} and got[3] == {"b", "c", "g"}
    assert got[2] == {"b"} and got[1] == {"b", "c", "p"} and got[0] == {"b", "c", "p"} and 7 not in got and g


def test_ranges_of_programs(spark):
    """Arithmetic, arrays, calls, negative literals."""
    u = Unit("ranges.c")
    f = u.function("f:main")
    x, y, a, z, w = u.var("x", f), u.var("y", f), u.var("a", f, V.ARR_FIXED), u.var("z", f), u.var("w", f)
    u.assign(f, value(x), value(u.const(-3)))
    u.assign(f, value(y), expr(X.MUL, x, u.const(5)))
    u.assign(f, expr(X.ARR_INDX, a, u.const(0)), value(u.const(11)))
    u.assign(f, expr(X.ARR_INDX, a, u.const(1)), value(u.const(22)))
    u.assign(f, value(z), expr(X.ARR_INDX, a, x))
    u.assign(f, value(w), expr(X.CALL, f))
    u.ret(f, w)
    assert ranges_after(spark, u, 6) == {"x": (-3, -3), "y": (-15, -15), "a": (11, 22), "z": (11, 22), "w": FULL}


def test_pointers_of_programs(spark):
    """p1 = &x; p2 = p1 + x; q = &p1; *q = arr; r = *q; h = f."""
    u = Unit("ptr.c")
    f = u.function("f:main")
    x, arr = u.var("x", f), u.var("arr", f, V.ARR_FIXED)
    p1, p2, r, h = (u.var(n, f, V.PTR_TO_INT) for n in ("p1", "p2", "r", "h"))
    q = u.var("q", f, V.PTR_TO_PTR)
    u.assign(f, value(p1), expr(X.ADDROF, x))
    u.assign(f, value(p2), expr(X.ADD, p1, x))
    u.assign(f, value(q), expr(X.ADDROF, p1))
    u.assign(f, value(r), expr(X.DEREF, q))
    u.assign(f, value(h), value(f))
    assert points(spark, u) == [("h", "f:main"), ("p1", "x"), ("p2", "x"), ("q", "p1"), ("r", "x")] and arr


def test_internal_ids(spark):
    u = Unit("ids.c")
    f = u.function("f:main")
    u.var("a", f), u.var("b", f), u.var("g"), u.label("l")
    t = u.tables(spark)
    d = spark.createDataFrame([(1, 500, 4, *[None] * 6, None, None, [], [], None, None)], t["data_type"].schema)
    got = {r["eid"]: r for r in types.assign_internal_ids(t["entity"], d).select("eid", "id", S.kind(F.col("id")).alias("k"), S.seq_id(F.col("id")).alias("n")).collect()}
    assert len(got) == 6 and len({r["id"] for r in got.values()}) == 6
    assert (got[u.ids["a"]]["n"], got[u.ids["b"]]["n"], got[500]["k"], got[500]["n"]) == (1, 2, 11, 1)
    x = F.lit(1).cast("long")
    r = spark.range(1).select(S.set_bit(x, 63), S.clear_bit(S.set_bit(x, 63), 63), S.top_bits(S.with_top_bits(x, F.lit(2)))).collect()[0]
    assert list(r) == [1 - 2**63, 1, 2]


def test_functions_without_instructions(spark):
    u = Unit("none.c")
    u.function("f:main")
    assert live_before(spark, u) == [] and points(spark, u) == []
    with pytest.raises(KeyError):
        u.ids["f:other"]
