"""Sets, maps, ids and graphs."""

import random

from pyspark.sql import functions as F

from meetflow.operators import graph, ids, maps, ranges, sets


def test_sets_against_python(spark):
    rng = random.Random(42)
    rows = [([rng.randrange(30) for _ in range(rng.randrange(9))], [rng.randrange(30) for _ in range(rng.randrange(9))], rng.random() < 0.15, rng.random() < 0.15) for _ in range(200)]
    d = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, ua boolean, ub boolean")
    d = d.select("*", sets.make(F.col("a"), F.col("ua")).alias("x"), sets.make(F.col("b"), F.col("ub")).alias("y"))
    x, y = F.col("x"), F.col("y")
    got = d.select("*", sets.union(x, y).alias("u"), sets.intersection(x, y).alias("i"), sets.difference(x, y).alias("d"), sets.is_subset(x, y).alias("s"),
                   sets.is_subset(x, y, proper=True).alias("p"), sets.equals(x, y).alias("e"), sets.contains(x, F.lit(3)).alias("c"), sets.text(x).alias("t"),
                   sets.is_normal(x["elems"]).alias("n"), sets.add(x, F.lit(3).cast("bigint")).alias("add"), sets.remove(x, F.lit(3).cast("bigint")).alias("rem")).collect()
    every = set(range(31))
    for r in got:
        a, b = every if r["ua"] else set(r["a"]), every if r["ub"] else set(r["b"])
        val = lambda s: every if s["is_all"] else set(s["elems"])
        assert val(r["u"]) == a | b and val(r["i"]) == a & b and r["s"] == (a <= b) and r["p"] == (a < b) and r["e"] == (a == b) and r["c"] == (3 in a)
        assert val(r["d"]) == (every if r["ua"] and not r["ub"] else a - b)
        assert r["n"] and val(r["add"]) == a | {3} and (r["ua"] or val(r["rem"]) == a - {3})
        assert r["t"] == ("{*}" if r["ua"] else "{" + ", ".join(map(str, sorted(a))) + "}")
        assert r["x"]["elems"] == ([] if r["ua"] else sorted(a))


def test_row_sets_and_may_meet(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "v int") for x in ([1, 2, 2, 3], [3, 4]))
    vals = lambda d: sorted(r["v"] for r in d.collect())
    assert vals(sets.rows_union(a, b)) == [1, 2, 3, 4] and vals(sets.rows_intersection(a, b)) == [3] and vals(sets.rows_difference(a, b)) == [1, 2]
    d = spark.createDataFrame([(1, [1], False), (1, [2, 1], False), (2, [1], False), (2, [], True)], "k int, v array<bigint>, u boolean")
    got = {r["k"]: r["m"] for r in d.select("k", sets.make(F.col("v"), F.col("u")).alias("s")).groupBy("k").agg(sets.may_meet_all("s").alias("m")).collect()}
    assert got[1]["elems"] == [1, 2] and not got[1]["is_all"] and got[2]["is_all"]


def test_maps(spark):
    m = lambda rows: spark.createDataFrame(rows, "o int, k string, lo long, hi long")
    a, b = m([(1, "x", 0, 5), (1, "y", 2, 2), (2, "x", 0, 9)]), m([(1, "x", 3, 8), (1, "z", 1, 1), (2, "x", 1, 2)])
    keys = ["o", "k"]
    rows = lambda d: sorted(tuple(r[c] for c in ("o", "k", "lo", "hi")) for r in d.collect())
    assert rows(maps.meet(a, b, keys, ranges.meet_all("lo", "hi"))) == [(1, "x", 0, 8), (1, "y", 2, 2), (1, "z", 1, 1), (2, "x", 0, 9)]

    def combine(j):
        lo, hi = ranges.join(*[F.col(c) for c in ("lo", "hi", "lo_b", "hi_b")])
        return j.select("o", "k", lo.alias("lo"), hi.alias("hi")).where("lo is not null")

    assert rows(maps.join(a, b, keys, combine)) == [(1, "x", 3, 5), (2, "x", 1, 2)]
    assert rows(maps.set_strong(a, b, keys)) == [(1, "x", 3, 8), (1, "y", 2, 2), (1, "z", 1, 1), (2, "x", 1, 2)]
    assert rows(maps.set_weak(a, b, keys, ranges.meet_all("lo", "hi"))) == rows(maps.meet(a, b, keys, ranges.meet_all("lo", "hi")))
    assert rows(maps.flatten([b, a], keys)) == rows(maps.set_strong(a, b, keys))
    test = lambda c: ranges.weaker(c("lo"), c("hi"), c("lo_b"), c("hi_b"))
    assert {r["o"]: r["weaker"] for r in maps.weaker(a, b, ["o"], ["k"], test).collect()} == {1: False, 2: True}
    assert {r["o"]: r["equal"] for r in maps.equal(a, a, ["o"], ["k"]).collect()} == {1: True, 2: True}
    assert {r["o"]: r["equal"] for r in maps.equal(a, b, ["o"], ["k"]).collect()} == {1: False, 2: False}
    assert {r["o"]: r["text"] for r in maps.text(a, ["o"], "k", F.col("hi")).collect()} == {1: "{x: 5, y: 2}", 2: "{x: 9}"}
    wanted = spark.createDataFrame([(1, "x"), (1, "q")], "o int, k string")
    assert {r["k"]: r["lo"] for r in maps.get([b, a], keys, wanted).collect()} == {"x": 3, "q": None}
    assert maps.all_keys([a, b], keys).count() == 4


def test_two_points_and_pairs(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    r = spark.range(1).select(maps.point_meet(t, n), maps.point_join(t, n), maps.point_weaker(t, f), maps.point_weaker(f, t), maps.point_weaker(n, n), maps.pair(maps.point_meet, t, f, f, f)).collect()[0]
    assert list(r)[:5] == [True, False, True, False, True] and (r[5]["in"], r[5]["out"]) == (True, False)


def test_ids(spark):
    d = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "p string, v int")
    got = sorted((r["p"], r["v"], r["id"]) for r in ids.allocate(d, ["p"], ["v"], 3).collect())
    assert [x[2] for x in got] == [1, 2, 3, 4, 5, 6, 7, 0, 0, 1]
    free = ids.free_ranges(spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 8, 10, 2)], "p string, v int"), ["p"], "v")
    rows = lambda x: sorted((r["lo"], r["hi"]) for r in x.collect())
    assert rows(free) == [(1, 3), (7, 8), (10, 10)]
    taken = spark.createDataFrame([("a", v) for v in (2, 10, 5)], "p string, v int")
    assert rows(ids.reserve(free, taken, ["p"], "v")) == [(1, 1), (3, 3), (7, 8)]
    files = ids.register_files(spark.createDataFrame([("/a/b.c",), ("/a/b.c",), ("x.c",)], "path string")).orderBy("path").collect()
    assert [(r["file_id"], r["directory"], r["name"]) for r in files] == [(1, "/a", "b.c"), (2, "", "x.c")]


INSN = "f int, seq int, ikind int, label int, true_label int, false_label int, target int"


def test_blocks_and_edges(spark):
    """if (c) goto 1 else 2; 1: x; goto 3; 2: 4: y; call; z; 3: return."""
    n = None
    rows = [(1, 0, 7, n, n, n, n), (1, 1, 14, n, 1, 2, n), (1, 2, 15, 1, n, n, n), (1, 3, 7, n, n, n, n), (1, 4, 13, n, n, n, 3), (1, 5, 15, 2, n, n, n), (1, 6, 15, 4, n, n, n),
            (1, 7, 7, n, n, n, n), (1, 8, 12, n, n, n, n), (1, 9, 7, n, n, n, n), (1, 10, 15, 3, n, n, n), (1, 11, 16, n, n, n, n), (2, 0, 7, n, n, n, n), (2, 1, 14, n, 9, 9, n)]
    placed = graph.blocks(spark.createDataFrame(rows, INSN), ["f"])
    by = {(r["f"], r["seq"]): r["bb"] for r in placed.collect()}
    assert [by[1, i] for i in range(12)] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 5]
    e = graph.edges(placed, ["f"])
    got = sorted((r["f"], r["src"], r["dst"], r["label"]) for r in e.collect())
    assert got == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 5, 0), (1, 2, 3, 0), (1, 3, 4, 0), (1, 4, 5, 0), (1, 5, -1, 0), (2, 0, -1, 1), (2, 0, -1, 2)]
    inner = {(r["src"], r["dst"]) for r in graph.insn_edges(placed, e, ["f"]).where("f = 1").collect()}
    assert {(0, 1), (1, 2), (1, 5), (4, 10), (8, 9), (9, 10)} <= inner
    assert {r["src"]: r["succ"] for r in graph.successors(e, ["f"]).where("f = 1").collect()}[0] == [1, 2]
    nodes = placed.select("f", F.col("bb").alias("node")).distinct()
    order = {r["node"]: r["position"] for r in graph.visiting_order(nodes, e.where("dst >= 0"), ["f"]).where("f = 1").collect()}
    assert order[0] == 0 and all(order[s] < order[d] for f, s, d, _ in got if f == 1 and d >= 0)
    entry = spark.createDataFrame([(1, 0), (2, 0)], "f int, node int")
    bad = graph.invalid_nodes(nodes, e, entry, spark.createDataFrame([], "f int, node int"), ["f", "node"])
    assert bad.count() == 0
    table = {(r["f"], r["bb"]): (r["first_seq"], r["last_seq"], r["is_entry"]) for r in graph.block_table(placed, ["f"]).collect()}
    assert table[1, 1] == (2, 4, False) and table[2, 0] == (0, 1, True)


def test_self_loops_and_contraction(spark):
    rows = [(1, 0, 15, 5, None, None, None), (1, 1, 14, None, 5, 5, None)]
    e = graph.edges(graph.blocks(spark.createDataFrame(rows, INSN), ["f"]), ["f"])
    assert sorted((r["src"], r["dst"], r["label"]) for r in e.collect()) == [(0, 0, 1), (0, 0, 2)]
    e = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0), (1, 1, 3, 1)], "f int, src int, dst int, label int")
    out = graph.contract(e, spark.createDataFrame([(1, 1), (1, 2)], "f int, node int"), ["f"])
    assert {(r["src"], r["dst"]) for r in out.collect()} == {(0, 3)}
    n = graph.node_numbers(spark.createDataFrame([(1, 0, 15), (1, 1, 7), (1, 2, 7)], "f int, seq int, ikind int"), ["f"], F.col("ikind") == 15)
    assert [r["node"] for r in n.orderBy("seq").collect()] == [None, 1, 2]


# fixed values: expected reverse post-orders of small graphs
SHAPES = {"line": ([(0, 1), (1, 2)], [0, 1, 2]), "diamond": ([(0, 1), (0, 2), (1, 3), (2, 3)], [0, 2, 1, 3]), "loop": ([(0, 1), (1, 2), (2, 1), (1, 3)], [0, 1, 3, 2]), "alone": ([], [0])}


def test_visiting_orders(spark):
    for name, (edges, want) in SHAPES.items():
        e = spark.createDataFrame([(1, s, d, i) for i, (s, d) in enumerate(edges)], "f int, src int, dst int, label int")
        nodes = spark.createDataFrame([(1, n) for n in {0, *(x for y in edges for x in y)}], "f int, node int")
        got = [r["node"] for r in graph.visiting_order(nodes, e, ["f"]).orderBy("position").collect()]
        back = [r["node"] for r in graph.visiting_order(nodes, e, ["f"], reverse_post=False).orderBy("position").collect()]
        assert got == want and back == want[::-1], name
