"""Registered queries across calls and over whole client paths.

Four events of a user in a row are a function: signups take addresses, views copy,
errors set something else, clicks may skip the next event, purchases call half
their own number or, for large k, themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import summaries
from .program_queries import PROG_SQL, program
from .registry import query

SIZE, VARS = 4, 4

FN_SQL = PROG_SQL + f""", fn AS (SELECT fid AS u, CAST(seq // {SIZE} AS BIGINT) AS c, seq % {SIZE} AS node, t, k, k % {VARS} AS x, (k + 1) % {VARS} AS y, (k + 2) % {VARS} AS z FROM ins),
 lst AS (SELECT u, c, max(node) + 1 AS ex FROM fn GROUP BY 1, 2), hop AS (SELECT fn.u, fn.c, node, node + 1 AS nx FROM fn UNION SELECT fn.u, fn.c, node, least(node + 2, ex) FROM fn JOIN lst ON lst.u = fn.u AND lst.c = fn.c WHERE t = 'click'),
 cl AS (SELECT u, c, node, CASE WHEN k < 70 THEN c // 2 ELSE c END AS cc, x, y, z FROM fn WHERE t = 'purchase')"""


def _level(n: int) -> str:
    """Path edges with calls inlined to depth n: calls at the last level never return."""
    back = "" if n == 0 else f""" UNION ALL SELECT p.u, p.c, p.par, p.obj, h.nx, cl.z FROM p{n} p JOIN cl ON cl.u = p.u AND cl.c = p.c AND cl.node = p.node JOIN hop h ON h.u = p.u AND h.c = p.c AND h.node = p.node
 JOIN s{n - 1} s ON s.u = p.u AND s.c = cl.cc AND ((s.par = 0 AND p.var = cl.x) OR (s.par = 1 AND p.var = cl.y))"""
    made = "" if n == 0 else f" UNION SELECT cl.u, cl.c, CAST(NULL AS BIGINT), s.obj, h.nx, cl.z FROM cl JOIN s{n - 1} s ON s.u = cl.u AND s.c = cl.cc AND s.obj IS NOT NULL JOIN hop h ON h.u = cl.u AND h.c = cl.c AND h.node = cl.node"
    return f"""p{n}(u, c, par, obj, node, var) AS (SELECT * FROM (SELECT u, c, CAST(par AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(par AS BIGINT) FROM lst, (SELECT unnest([0, 1]) AS par) a
 UNION SELECT fn.u, fn.c, NULL, k % 10, h.nx, x FROM fn JOIN hop h ON h.u = fn.u AND h.c = fn.c AND h.node = fn.node WHERE t = 'signup'{made}) i
 UNION SELECT * FROM (SELECT p.u, p.c, p.par, p.obj, h.nx, CASE WHEN fn.t = 'view' AND w.cp THEN fn.x ELSE p.var END FROM p{n} p JOIN fn ON fn.u = p.u AND fn.c = p.c AND fn.node = p.node JOIN hop h ON h.u = p.u AND h.c = p.c AND h.node = p.node
 JOIN (SELECT unnest([true, false]) AS cp) w ON CASE WHEN w.cp THEN fn.t = 'view' AND p.var = fn.y ELSE NOT (p.var = CASE WHEN fn.t IN ('view', 'signup', 'error') THEN fn.x WHEN fn.t = 'purchase' THEN fn.z ELSE -1 END) END{back}) r),
 s{n} AS (SELECT p.u, p.c, p.par, p.obj FROM p{n} p JOIN lst ON lst.u = p.u AND lst.c = p.c AND p.node = ex WHERE var = 2)"""


#: Calls go at most six deep (25 functions a user, halved); the rest is for functions that call themselves.
DEPTH = 12
PATHS_SQL = f"WITH RECURSIVE {FN_SQL}, " + ",\n ".join(_level(n) for n in range(DEPTH + 1))


def functions(spark, sf_dir) -> summaries.Program:
    d = program(spark, sf_dir).select("fid", F.expr(f"seq div {SIZE}").alias("c"), F.expr(f"cast(seq % {SIZE} as int)").alias("node"), "t", "k")
    d = d.withColumns({"function": F.struct("fid", "c"), "x": F.col("k") % VARS, "y": (F.col("k") + 1) % VARS, "z": (F.col("k") + 2) % VARS})
    bounds = d.groupBy("function").agg(F.lit(0).alias("entry"), (F.max("node") + 1).cast("int").alias("exit"))
    far = d.where("t = 'click'").join(bounds, "function").select("function", F.col("node").alias("src"), F.least(F.col("node") + 2, F.col("exit")).alias("dst"))
    edges = d.select("function", F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).unionByName(far)
    moves = d.where("t in ('signup', 'view', 'error')").select("function", "node", F.col("x").alias("target"), F.when(F.col("t") == "view", F.col("y")).alias("source"), F.when(F.col("t") == "signup", F.col("k") % 10).alias("object"))
    call = d.where("t = 'purchase'")
    calls = call.select("function", "node", F.struct("fid", F.when(F.col("k") < 70, F.expr("c div 2")).otherwise(F.col("c")).alias("c")).alias("callee"))
    args = call.select("function", "node", F.inline(F.array(F.struct(F.lit(0).cast("bigint").alias("param"), F.col("x").alias("arg")), F.struct(F.lit(1).cast("bigint").alias("param"), F.col("y").alias("arg")))))
    return summaries.Program(edges, bounds, moves, calls, args, call.select("function", "node", F.col("z").alias("target"), F.lit(2).cast("bigint").alias("result")))


@query(PATHS_SQL + f" SELECT DISTINCT u AS fid, c, coalesce(par, -1) AS param, coalesce(obj, -1) AS object, CAST(var AS BIGINT) AS result FROM (SELECT p.* FROM p{DEPTH} p JOIN lst ON lst.u = p.u AND lst.c = p.c AND p.node = ex) q")
def summary_table(spark, sf_dir):
    """What each function's variables hold at its exit, by what its two parameters held; equal to calls inlined twelve deep."""
    p = functions(spark, sf_dir)
    both = p.bounds.select("function", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("param"))
    got = summaries.summaries(summaries.path_edges(p, both), p.bounds)
    return got.select("function.fid", "function.c", F.coalesce("param", F.lit(-1)).alias("param"), F.coalesce("object", F.lit(-1)).alias("object"), "result")


@query(PATHS_SQL + f""", ac AS (SELECT DISTINCT p.u, p.c, p.par, p.obj, cl.cc, CAST(a.par AS BIGINT) AS tp FROM p{DEPTH} p JOIN cl ON cl.u = p.u AND cl.c = p.c AND cl.node = p.node JOIN (SELECT unnest([0, 1]) AS par) a ON p.var = CASE a.par WHEN 0 THEN cl.x ELSE cl.y END),
 v(u, c, par, obj) AS (SELECT u, cc, tp, obj FROM ac WHERE obj IS NOT NULL UNION SELECT u, c, CAST(0 AS BIGINT), CAST(100 AS BIGINT) FROM lst WHERE c = 24 UNION SELECT ac.u, ac.cc, ac.tp, v.obj FROM v JOIN ac ON ac.u = v.u AND ac.c = v.c AND ac.par = v.par)
 SELECT DISTINCT u AS fid, c, node, CAST(var AS BIGINT) AS var, obj AS object FROM (SELECT u, c, node, var, obj FROM p{DEPTH} WHERE obj IS NOT NULL UNION SELECT p.u, p.c, node, var, v.obj FROM p{DEPTH} p JOIN v ON v.u = p.u AND v.c = p.c AND v.par = p.par) q""")
def summary_points_to(spark, sf_dir):
    """What variables hold before every node of every function, over all matching calls and returns; the 25th function of a user gets object 100."""
    p = functions(spark, sf_dir)
    start = p.bounds.where("function.c = 24").select("function", F.lit(0).cast("bigint").alias("param"), F.lit(100).cast("bigint").alias("object"))
    got = summaries.points_to_across_calls(p, start)
    return got.select("function.fid", "function.c", F.col("node"), "var", "object")
