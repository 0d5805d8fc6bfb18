"""Fixed points on chains, replaced values, ids given out again, deep types, empty versions."""

import random

import pytest
from pyspark.sql import functions as F

from meetflow.functions import scalars as S
from meetflow.operators import ids, ranges
from meetflow.plans import analyses
from meetflow.plans.framework import Analysis, Solver
from meetflow.plans.rounds import close_rows, shared_dir
from meetflow.sources import text
from meetflow.streaming.incremental import analyse_stream, current


def closure(pairs, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_long_chain_in_few_tables(spark):
    """60 hops and a loop; rounds after the first few take four steps."""
    pairs = [(i, i + 1) for i in range(60)] + [(30, 5), (100, 101)]
    e = spark.createDataFrame(pairs, "src int, dst int")
    got = analyses.reach(e, spark.createDataFrame([(0,)], "node int"))
    assert {r["node"] for r in got.collect()} == set(range(61))
    step = lambda d: d.join(e, d["node"] == e["src"]).select(F.col("dst").alias("node"))
    known = spark.createDataFrame([(i,) for i in range(40, 61)], "node int")
    more = close_rows(spark.createDataFrame([(38,), (100,)], "node int"), step, known=known)
    assert sorted(r["node"] for r in more.collect()) == [38, 39, *range(40, 61), 100, 101]
    with pytest.raises(RuntimeError):
        close_rows(spark.createDataFrame([(0,)], "node int"), step, most_rounds=3)


def test_points_to_random(spark):
    """Against a plain worklist, with loads and stores."""
    rng = random.Random(6)
    rel = {k: {(rng.randrange(12), rng.randrange(12)) for _ in range(n)} for k, n in (("address", 6), ("copy", 7), ("load", 5), ("store", 5))}
    pts = set(rel["address"])
    while True:
        new = {(p, x) for p, q in rel["copy"] for r, x in pts if r == q}
        new |= {(p, x) for p, q in rel["load"] for r, t in pts if r == q for u, x in pts if u == t}
        new |= {(t, x) for p, q in rel["store"] for r, t in pts if r == p for u, x in pts if u == q}
        if new <= pts:
            break
        pts |= new
    d = {k: spark.createDataFrame(sorted(v), f"p int, {'x' if k == 'address' else 'q'} int") for k, v in rel.items()}
    assert {(r["p"], r["x"]) for r in analyses.points_to(**d).collect()} == pts


class Newest(Analysis):
    """The value of the node before, or a node's own."""

    name, values = "newest", ("v",)

    def boundary(self, nodes):
        return nodes.withColumn("v", F.lit(9))

    def transfer(self, facts):
        return facts.withColumn("v", F.col("v") - 1)

    def meet(self):
        return [F.max("v").alias("v")]


def test_replacing(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src int, dst int")
    f = Solver(Newest(), e, spark.createDataFrame([(0,)], "node int"), meet_at_blocks=False).run()
    assert {(r["node"], r["point"]): r["v"] for r in f.collect()} == {(n, p): 9 - n - (p == "OUT") for n in range(4) for p in ("IN", "OUT")}


def test_ids_again(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "pool string, n int")
    free = spark.createDataFrame([("a", 2, 3), ("a", 7, 7)], "pool string, lo long, hi long")
    got = {(r["pool"], r["n"]): r["id"] for r in ids.allocate(rows, ["pool"], ["n"], 4, start=10, free=free).collect()}
    assert got == {("a", 0): 2, ("a", 1): 3, ("a", 2): 7, ("a", 3): 10, ("a", 4): 11, ("b", 0): 10}
    with pytest.raises(Exception, match="used up"):
        ids.allocate(rows, ["pool"], ["n"], 2, strict=True).collect()
    files = ids.register_files(spark.createDataFrame([("/a/b.c",), ("/a/a.c",), (None,), ("/a/b.c",), ("x.c",)], "path string"))
    assert [(r["file_id"], r["path"], r["directory"], r["name"]) for r in files.orderBy("file_id").collect()] == [(1, "/a/a.c", "/a", "a.c"), (2, "/a/b.c", "/a", "b.c"), (3, "x.c", "", "x.c")]


def test_deep_and_looping_types(spark):
    rows = [(1, i, 18, None, i + 1, None) for i in range(1, 40)] + [(1, 40, 25, 3, 41, None), (1, 41, 29, None, None, "s"), (1, 50, 18, None, 51, None), (1, 51, 18, None, 50, None), (1, 60, 18, None, 0, None)]
    d = spark.createDataFrame(rows, "tu_id long, type_id long, vkind int, len int, sub_type_eid long, type_name string")
    got = {r["type_id"]: r["text"] for r in text.type_text(d).collect()}
    assert got[1] == "struct s[3]" + "*" * 39 and got[40] == "struct s[3]" and got[60] == "int32*" and got[50] == got[51] == "..."


def test_wrapping_and_ranges_of_one_kind(spark):
    low, high = -(2**63), 2**63 - 1
    d = spark.createDataFrame([(2, high, 1), (3, low, 1), (4, 2**62, 4), (5, low, -1), (6, low, -1), (4, low, -1), (5, 7, 0), (2, None, 1)], "x int, a long, b long")
    got = [r[0] for r in d.select(S.evaluate(F.col("x"), F.col("a"), F.col("b"))).collect()]
    assert got == [low, high, 0, low, 0, low, None, None]
    assert d.select(S.evaluate_unary(F.lit(24), F.lit(low))).first()[0] == low
    with pytest.raises(Exception, match="ranges of kinds"):
        d.select(ranges.of_kind(F.lit(3), F.lit(4), F.col("a"))).collect()
    with pytest.raises(Exception, match="12 bits"):
        d.select(S.instance_id(F.lit(5000), F.lit(1))).collect()


def test_versions_without_facts(spark, tmp_path):
    src, out, schema = tmp_path / "in", str(tmp_path / "out"), "fn string, version int, ikind int"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        analyse_stream(spark.readStream.schema(schema).parquet(str(src)), ["fn"], "version", lambda d: d.where("ikind > 0").groupBy("fn").agg(F.count(F.lit(1)).alias("n")), out, str(tmp_path / "cp")).awaitTermination(120)
        return current(spark.read.parquet(out), ["fn"], "version", spark.read.parquet(out + "-versions"))

    assert {r["fn"] for r in go([("f", 1, 7), ("g", 1, 7)]).collect()} == {"f", "g"}
    now = go([("f", 2, 0)])
    assert {r["fn"] for r in now.collect()} == {"g"}
    assert not current(spark.read.parquet(out), ["fn"], "version", spark.read.parquet(out + "-versions"), spark.createDataFrame([("g",)], "fn string")).count()


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
