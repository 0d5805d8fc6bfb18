"""The analysis interface, types of units, and units built by hand."""

import pytest
from pyspark.sql import functions as F

from meetflow.functions.kinds import EntityKind as E
from meetflow.functions.kinds import ValueKind as V
from meetflow.operators import graph, maps, types
from meetflow.plans.framework import Analysis, BackwardBottom, Context, ForwardBottom, Solver, close_together, run_staged
from meetflow.sources import build, wire


def edges(spark, pairs):
    return spark.createDataFrame([("f", s, d) for s, d in pairs], "fn string, src int, dst int")


def ends(spark, *nodes):
    return spark.createDataFrame([("f", n) for n in nodes], "fn string, node int")


def at(facts, point):
    return sorted(r["node"] for r in facts.where(F.col("point") == point).collect())


def test_two_points(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 1), (3, 2), (2, 4)])
    ctx = Context(function="f:main")
    f = Solver(ForwardBottom(), e, ends(spark, 0), ["fn"], context=ctx).run()
    assert at(f, "IN") == at(f, "OUT") == [0, 1, 2, 4]
    assert ctx.in_main() and ctx.get("forward-bottom") is f and ctx.remove("forward-bottom") is f and ctx.get("forward-bottom") is None
    b = Solver(BackwardBottom(), e, ends(spark, 4), ["fn"]).run()
    assert at(b, "IN") == at(b, "OUT") == [0, 1, 2, 3, 4]
    s = Solver(ForwardBottom(), e, ends(spark, 0), ["fn"], skip_calls=ends(spark, 1)).run()
    assert at(s, "IN") == [0, 1]


class Distance(Analysis):
    """Longest distance from the entry, cut off at 5."""

    name, values = "distance", ("d",)

    def boundary(self, nodes):
        return nodes.withColumn("d", F.lit(0))

    def transfer(self, facts):
        return facts.withColumn("d", F.least(F.col("d") + 1, F.lit(5)))

    def meet(self):
        return [F.max("d").alias("d")]


class Widened(Distance):
    def transfer(self, facts):
        return facts.withColumn("d", F.col("d") + 1)

    def widen(self, rows):
        return rows.withColumn("d", F.when(F.col("_had") & (F.col("d") > F.col("old_d")), 99).otherwise(F.least("d", F.lit(99))))


def test_own_analysis(spark):
    e = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 3)])
    f = Solver(Distance(), e, ends(spark, 0), ["fn"]).run()
    assert {r["node"]: r["d"] for r in f.where("point = 'OUT'").collect()} == {0: 1, 1: 2, 2: 3, 3: 5}
    w = Solver(Widened(), e, ends(spark, 0), ["fn"], widen_after=3).run()
    assert {r["node"]: r["d"] for r in w.where("point = 'OUT'").collect()}[3] == 99
    assert Distance().block_transfer(f) is None


def test_stages_and_lockstep(spark):
    ctx = run_staged([("a", lambda c: ends(spark, 1)), ("b", lambda c: c.get("a").union(ends(spark, 2)))])
    assert ctx.get("b").count() == 2
    copy = spark.createDataFrame([("q", "p")], "p string, q string")
    load = spark.createDataFrame([("r", "q")], "p string, q string")
    pts = lambda t: t["pts"].withColumnRenamed("p", "q").join(t["edge"], "q").select("p", "x")
    edge = lambda t: load.join(t["pts"].select(F.col("p").alias("q"), F.col("x").alias("y")), "q").select("p", F.col("y").alias("q"))
    got = close_together({"pts": spark.createDataFrame([("p", "a"), ("a", "b")], "p string, x string"), "edge": copy}, {"pts": pts, "edge": edge})
    assert sorted(map(tuple, got["pts"].collect())) == [("a", "b"), ("p", "a"), ("q", "a"), ("r", "b")]


def test_built_units(spark, tmp_path):
    u = build.example_branch()
    t = u.tables(spark)
    (tmp_path / "x.pb").write_bytes(u.wire())
    back = wire.read_units(spark, str(tmp_path))
    assert [r["ikind"] for r in back["insn"].orderBy("seq").collect()] == [14, 15, 7, 13, 15, 7, 15, 16] == [r["ikind"] for r in t["insn"].orderBy("seq").collect()]
    i = t["insn"].select("fid", "seq", "ikind", *[F.col("expr1")["op1"].alias(c) for c in ("label", "target")], F.col("expr2")["op1"].alias("true_label"), F.col("expr2")["op2"].alias("false_label"))
    e = graph.edges(graph.blocks(i, ["fid"]), ["fid"])
    assert sorted((r["src"], r["dst"], r["label"]) for r in e.collect()) == [(0, 1, 1), (0, 2, 2), (1, 3, 0), (2, 3, 0), (3, -1, 0)]
    s = build.example_sum()
    assert s.tables(spark)["insn"].collect()[0]["expr2"]["xkind"] == 2
    f = s.ids["f:main"]
    with pytest.raises(ValueError, match="both sides"):
        s.assign(f, build.expr(build.X.DEREF, 3), build.expr(build.X.ADD, 3, 4))
    with pytest.raises(ValueError, match="there already"):
        s.var("v:main:x", f)
    for go in (lambda: s.nop(f), lambda: s.barrier(f), lambda: s.use(f, 3, 4, 5), lambda: s.use(f, 3, kill=True), lambda: s.self_assign(f, 3), lambda: s.call(f, f, 3)):
        go()
    assert [r["ikind"] for r in s.rows["insn"]] == [8, 1, 2, 5, 4, 6, 12]


def test_types(spark):
    u = build.Unit("t.c")
    f = u.function("f:main")
    u.var("g:g")
    x = u.var("v:main:x", f)
    u.const(5), u.const(2**40, V.INT64), u.label("end"), u.entity(E.LIT_STR, V.PTR_TO_CHAR, None, str_val="s")
    t = u.tables(spark)
    d = spark.createDataFrame([(1, 30, 29, None, None, None, None, "s", None, None, None, [x], [0], None, None), (1, 31, 21, None, None, None, 30, None, None, None, None, [], [], None, None)], t["data_type"].schema)
    assert [(r["member"], r["member_type"]) for r in types.members(d).collect()] == [(x, 0)]
    assert [(r["type_id"], r["target"]) for r in types.targets(d).collect()] == [(31, 30)]
    bad = d.withColumn("fop_ids", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    with pytest.raises(Exception, match="differ in length"):
        types.members(bad).collect()
    assert sorted((r["text"], r["immediate"]) for r in types.literals(t["entity"]).collect()) == [("1099511627776", False), ("5", True), ("s", False)]
    assert types.global_variables(t["entity"]).count() == 1 and [r["name"] for r in types.labels(t["entity"]).collect()] == ["end"]
    v = types.variables(t["entity"].withColumn("qtype", F.lit(17)), d).collect()
    assert len(v) == 2 and v[0]["qualifiers"] == ["CONST", "VOLATILE"] and v[0]["class"] == "basic"
    ids = spark.createDataFrame([(1, 7, 70)], "tu_id long, eid long, id long")
    use = lambda *x: spark.createDataFrame([(1, i) for i in x], "tu_id long, eid long")
    assert sorted(r["id"] for r in types.internal_ids(use(0, 1, 7), ids).collect()) == [0, 1, 70]
    with pytest.raises(Exception, match="unknown entity 8"):
        types.internal_ids(use(8), ids).collect()


def test_stores(spark):
    s = F.create_map(F.lit(1), F.lit(10), F.lit(2), F.lit(20))
    put, gone, got, none = spark.range(1).select(maps.store_put(s, F.lit(2), F.lit(9)), maps.store_remove(s, F.lit(1)), maps.store_get(s, F.lit(2)), maps.store_get(s, F.lit(5))).collect()[0]
    assert (put, gone, got, none) == ({1: 10, 2: 9}, {2: 20}, 20, None)
    m = spark.range(1).select(maps.store_meet(s, F.create_map(F.lit(2), F.lit(5), F.lit(3), F.lit(1)), F.greatest)).collect()[0][0]
    assert m == {1: 10, 2: 20, 3: 1}
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    w = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r["k"]: r["v"] for r in maps.with_default(d, w, ["k"], {"v": 7}).collect()} == {"a": 1, "b": 7}
    assert maps.scoped(d, w.where("k = 'b'"), ["k"]).count() == 0


def test_units_as_text(spark):
    """Units built by hand, as text; instructions of the other constructors."""
    from meetflow.functions.kinds import ExprKind as X
    from meetflow.sources import text

    every = build.Unit("all.c")
    f = every.function("f:main")
    g, a, b = every.function("callee"), every.var("v:main:a", f), every.var("v:main:b", f)
    every.nop(f), every.barrier(f), every.use(f, a, b), every.self_assign(f, a), every.call(f, g, a)
    every.assign(f, build.value(a), build.expr(X.CALL, g, None, [b]))
    every.assign(f, build.expr(X.DEREF, a), build.value(b))

    def lines(u):
        t = u.tables(spark)
        ops = text.operand_text(t["entity"], text.names(t["entity"], t["name_id"], t["data_type"]))
        return [r["text"] for r in text.insn_text(t["insn"], ops).orderBy("seq").collect()]

    assert lines(build.example_sum()) == ["x = y + 10"]
    assert lines(build.example_branch()) == ["if c", "yes:", "x = 1", "goto end", "no:", "x = 2", "end:", "return x"]
    assert lines(every) == ["nop", "barrier", "use", "a", "callee(a)", "a = callee(b)", "*a = b"]
    bad = build.Rows.assign(build.Rows.expr(X.DEREF, F.col("id")), build.Rows.expr(X.ADD, F.col("id"), F.col("id")))
    with pytest.raises(Exception, match="both sides are compound"):
        spark.range(1).select(bad["ikind"]).collect()
