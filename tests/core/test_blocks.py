"""Block transfers, globals as one variable, contraction and reserved ids against plain Python."""

import random

from pyspark.sql import functions as F

from meetflow.operators import graph, ids
from meetflow.plans import analyses
from meetflow.plans.framework import GenKill, Solver


def random_blocks(rng, backward):
    """A graph of blocks of one to six nodes, and events of three variables."""
    n = rng.randint(2, 6)
    placed, node = [], 0
    for b in range(n):
        for _ in range(rng.randint(1, 6)):
            placed.append(("f", b, node))
            node += 1
    e = sorted({("f", rng.randrange(n), rng.randrange(n)) for _ in range(n + 3)})
    events = [("f", m, rng.choice("xyz"), rng.random() < 0.5) for _, _, m in placed for _ in range(rng.randint(0, 2))]
    return placed, e, events


def test_blocks_equal_nodes(spark):
    """Solving blocks gives the facts that solving nodes gives, both ways, with facts at the boundary."""
    rng = random.Random(6)
    for backward in (False, True, False, True):
        placed, e, events = random_blocks(rng, backward)
        p = spark.createDataFrame(placed, "fn string, bb int, node int")
        be = spark.createDataFrame(e, "fn string, src int, dst int").withColumn("label", F.lit(0))
        first = {b: min(m for _, c, m in placed if c == b) for _, b, _ in placed}
        last = {b: max(m for _, c, m in placed if c == b) for _, b, _ in placed}
        end = rng.randrange(len(first))
        ev = spark.createDataFrame(events, "fn string, node int, var string, made boolean")
        by_block = GenKill(ev, ["fn"], backward=backward, entry=spark.createDataFrame([("f", end, "x")], "fn string, node int, var string"))
        at = (last if backward else first)[end]
        by_node = GenKill(ev, ["fn"], backward=backward, entry=spark.createDataFrame([("f", at, "x")], "fn string, node int, var string"))
        ie = graph.insn_edges(p, be, ["fn"], seq="node")
        one = lambda x: spark.createDataFrame([("f", x)], "fn string, node int")
        got = Solver(by_block, be, one(end), ["fn"], blocks=p).run()
        want = Solver(by_node, ie, one(at), ["fn"]).run()
        rows = lambda d: sorted((r["node"], r["point"], r["var"]) for r in d.where("bottom").collect())
        assert rows(got) == rows(want)


def test_globals_as_one(spark):
    """One row for all globals means the same as a row for each, over branches and loops."""
    rng, fn = random.Random(3), ["tu", "fn"]
    universe = [(1, g) for g in range(100, 112)]
    effects, marked, edges, ends = [], [], [], []
    for f in range(6):
        for n in range(7):
            edges += [(1, f, n, n + 1)] * (n < 6) + [(1, f, n, rng.randrange(7))] * (rng.random() < 0.4)
            kind, x, y = rng.choice("cakun"), rng.choice([100, 101, 102, 7, 8]), rng.choice([100, 103, 7, 8])
            if kind == "c":
                effects += [(1, f, n, None, g, True) for _, g in universe]
                marked.append((1, f, n, None, analyses.UNIVERSE, True))
            rest = {"a": [(x, None, False), (x, y, False)], "k": [(-1, None, False)], "u": [(None, y, True)]}.get(kind, [])
            effects += [(1, f, n, *r) for r in rest]
            marked += [(1, f, n, *r) for r in rest]
        if f % 2:
            ends.append((1, f, 6))
    cols = "tu long, fn long, node long, target long, source long, always boolean"
    d, m = spark.createDataFrame(effects, cols), spark.createDataFrame(marked, cols)
    e, u = spark.createDataFrame(edges, "tu long, fn long, src long, dst long"), spark.createDataFrame(universe, "tu long, var long")
    out = spark.createDataFrame(ends, "tu long, fn long, node long")
    want = analyses.strong_liveness(d, e, fn, exit_live=out.join(u, "tu"))
    live = analyses.strong_liveness(m, e, fn, exit_live=out.withColumn("var", F.lit(analyses.UNIVERSE).cast("long")), universe=u)
    rows = lambda d: sorted(map(tuple, d.select(*fn, "node", "var").collect()))
    assert rows(analyses.expanded(live, m, u, fn)) == rows(want) and live.count() < want.count() / 2


def test_contraction_of_cycles(spark):
    """Three gotos in a cycle, a chain of nine, a dropped entry; edges keep the label they began with."""
    cycle = [("f", 0, 1, 1), ("f", 1, 2, 0), ("f", 2, 3, 0), ("f", 3, 1, 0), ("f", 0, 9, 2), ("f", 3, 8, 0)]
    chain = [("g", i, i + 1, int(i == 0)) for i in range(10)] + [("g", 10, 10, 3)]
    e = spark.createDataFrame(cycle + chain, "fn string, src int, dst int, label int")
    drop = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), *[("g", i) for i in range(1, 10)]], "fn string, node int")
    got = sorted(map(tuple, graph.contract(e, drop, ["fn"]).collect()))
    assert got == [("f", 0, 8, 1), ("f", 0, 9, 2), ("g", 0, 10, 1), ("g", 10, 10, 3)]


def test_reserved_ids(spark):
    rng = random.Random(1)
    ranges, taken = [], []
    for p in range(4):
        free = sorted(rng.sample(range(60), 40))
        island = []
        for x in free:
            if island and x != island[-1] + 1:
                ranges.append((p, island[0], island[-1]))
                island = []
            island.append(x)
        ranges.append((p, island[0], island[-1]))
        taken += [(p, x) for x in rng.sample(range(60), 15)] * 2
    got = ids.reserve(spark.createDataFrame(ranges, "pool int, lo int, hi int"), spark.createDataFrame(taken, "pool int, v int"), ["pool"], "v")
    left = sorted((p, x) for p, lo, hi in map(tuple, got.collect()) for x in range(lo, hi + 1))
    assert left == sorted((p, x) for p, lo, hi in ranges for x in range(lo, hi + 1) if (p, x) not in taken)
