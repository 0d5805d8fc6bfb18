"""Registered queries over programs made from the test tables: graphs, solver, clients, types, texts, units.

A user is a function and its events are instructions: views are labels, clicks
conditions, signups assignments, purchases calls, errors gotos or returns.  Parts
are types, customers entities.  All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.kinds import ChangeCode, EntityKind, ExprKind, InsnKind, Qualifier, ValueKind
from .operators import bitsets, graph, ids, maps, ranges, sets, types
from .plans import analyses, clients, dominance, link, views
from .plans.framework import Analysis, BackwardBottom, Context, ForwardBottom, GenKill, Solver, close_together, run_cooperating, run_staged
from .plans.rounds import Tables
from .registry import query, table
from .sources import build, text, wire

X, I, E, V = ExprKind, InsnKind, EntityKind, ValueKind

# programs

PROG_SQL = """ev AS (SELECT user_id AS fid, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq FROM events),
 ins AS (SELECT fid, seq, k, t, CASE t WHEN 'view' THEN 15 WHEN 'click' THEN 14 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 12 ELSE CASE WHEN k < 20 THEN 16 ELSE 13 END END AS ikind FROM ev)"""
BLOCK_SQL = PROG_SQL + """, l1 AS (SELECT *, lag(ikind) OVER (PARTITION BY fid ORDER BY seq) AS pk FROM ins),
 l2 AS (SELECT *, CASE WHEN pk IS NULL OR pk IN (10, 12, 13, 14, 16) OR (ikind = 15 AND pk <> 15) OR (ikind IN (10, 12) AND pk <> 15) THEN 1 ELSE 0 END AS ld FROM l1),
 pl AS (SELECT fid, seq, k, ikind, CAST(sum(ld) OVER (PARTITION BY fid ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS bb FROM l2),
 la AS (SELECT * FROM (SELECT *, lead(bb) OVER (PARTITION BY fid ORDER BY seq) AS nx FROM pl) z WHERE nx IS NULL OR nx <> bb),
 lb AS (SELECT DISTINCT fid, k % 10 AS lab, bb AS dst FROM pl WHERE ikind = 15),
 ou AS (SELECT fid, bb AS src, 1 AS label, k % 10 AS lab, CAST(NULL AS INT) AS d FROM la WHERE ikind = 14 UNION ALL SELECT fid, bb, 2, (k + 1) % 10, NULL FROM la WHERE ikind = 14
 UNION ALL SELECT fid, bb, 0, k % 10, NULL FROM la WHERE ikind = 13 UNION ALL SELECT fid, bb, 0, NULL, CASE WHEN ikind = 16 THEN -1 ELSE coalesce(nx, -1) END FROM la WHERE ikind NOT IN (13, 14)),
 ed AS (SELECT ou.fid, src, CAST(coalesce(d, dst, -1) AS INT) AS dst, label FROM ou LEFT JOIN lb ON ou.fid = lb.fid AND ou.lab = lb.lab),
 be AS (SELECT fid, src, dst, CAST(CASE WHEN label = 0 AND dst >= 0 AND dst <= src THEN 3 ELSE label END AS TINYINT) AS label FROM ed)"""


def program(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k, t = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(t == "view", 15).when(t == "click", 14).when(t == "signup", 7).when(t == "purchase", 12).when(k < 20, 16).otherwise(13)
    d = e.select(F.col("user_id").alias("fid"), (F.row_number().over(w) - 1).alias("seq"), k.alias("k"), t.alias("t"), kind.alias("ikind"))
    return d.withColumns({"label": F.expr("k % 10"), "true_label": F.expr("k % 10"), "false_label": F.expr("(k + 1) % 10"), "target": F.expr("k % 10")})


def block_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    placed = graph.blocks(program(spark, sf_dir), ["fid"])
    return placed, graph.edges(placed, ["fid"])


def kept_graph(t: Tables, spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same as tables, for queries that read them often."""
    placed = t.keep(graph.blocks(program(spark, sf_dir), ["fid"]))
    return placed, t.keep(graph.edges(placed, ["fid"]))


@query(f"WITH {BLOCK_SQL} SELECT * FROM be")
def cfg_edges(spark, sf_dir):
    return block_graph(spark, sf_dir)[1]


@query(f"""WITH {BLOCK_SQL}, i AS (SELECT fid, seq AS src, lead(seq) OVER (PARTITION BY fid, bb ORDER BY seq) AS dst, 0 AS label FROM pl),
 b AS (SELECT fid, bb, min(seq) AS f, max(seq) AS l FROM pl GROUP BY 1, 2) SELECT fid, src, dst, CAST(label AS TINYINT) AS label FROM i WHERE dst IS NOT NULL UNION ALL
 SELECT be.fid, p.l, q.f, be.label FROM be JOIN b p ON p.fid = be.fid AND p.bb = be.src JOIN b q ON q.fid = be.fid AND q.bb = be.dst""")
def cfg_insn_edges(spark, sf_dir):
    return graph.insn_edges(*block_graph(spark, sf_dir), ["fid"])


@query(f"""WITH {BLOCK_SQL}, n AS (SELECT DISTINCT fid, bb FROM pl), x AS (SELECT DISTINCT fid, src FROM be WHERE dst = -1)
 SELECT fid, bb, 'predecessor' AS lacks FROM n WHERE bb <> 0 AND (fid, bb) NOT IN (SELECT (fid, dst) FROM be) UNION ALL
 SELECT fid, bb, 'successor' FROM n WHERE (fid, bb) NOT IN (SELECT (fid, src) FROM be WHERE dst >= 0) AND (fid, bb) NOT IN (SELECT (fid, src) FROM x)""")
def cfg_invalid(spark, sf_dir):
    """Blocks that nothing leads to (after returns and gotos without a label)."""
    placed, e = block_graph(spark, sf_dir)
    nodes = placed.select("fid", "bb").distinct()
    exits = e.where("dst = -1").select("fid", F.col("src").alias("bb")).distinct()
    return graph.invalid_nodes(nodes, e.where("dst >= 0"), nodes.where("bb = 0"), exits, ["fid", "bb"])


@query(f"""WITH {BLOCK_SQL}, b AS (SELECT fid, bb, min(seq) AS first_seq, max(seq) AS last_seq, CAST(count(*) AS INT) AS size FROM pl GROUP BY 1, 2),
 p AS (SELECT fid, dst, list_sort(list(src)) AS pred FROM be GROUP BY 1, 2)
 SELECT b.fid, b.bb, first_seq, last_seq, b.bb = 0 AS is_entry, size > 64 AS over_limit, coalesce(array_to_string(pred, ' '), '') AS pred FROM b LEFT JOIN p ON p.fid = b.fid AND p.dst = b.bb""")
def graph_blocks(spark, sf_dir):
    """Every block with its ends, whether it is the entry, and its predecessors."""
    placed, e = block_graph(spark, sf_dir)
    pred = graph.predecessors(e, ["fid"]).withColumnRenamed("dst", "bb")
    b = graph.block_table(placed, ["fid"]).join(pred, ["fid", "bb"], "left")
    return b.select("fid", "bb", "first_seq", "last_seq", "is_entry", "over_limit", F.coalesce(F.array_join(F.col("pred").cast("array<string>"), " "), F.lit("")).alias("pred"))


@query(f"""WITH {PROG_SQL} SELECT fid, seq, CAST(CASE WHEN ikind NOT IN (13, 15) THEN row_number() OVER (PARTITION BY fid, ikind IN (13, 15) ORDER BY seq) ELSE 0 END AS INT) AS node,
 CAST(CASE WHEN ikind = 7 THEN 1000 + seq WHEN ikind NOT IN (13, 15) THEN row_number() OVER (PARTITION BY fid, ikind IN (13, 15) ORDER BY seq) ELSE 0 END AS INT) AS kept FROM ins""")
def insn_numbers(spark, sf_dir):
    """Ids of instructions that take part; assignments that have one keep it."""
    d = graph.node_numbers(program(spark, sf_dir), ["fid"], S.skipped(F.col("ikind")))
    d = d.withColumn("old", F.when(F.col("ikind") == 7, F.col("seq") + 1000)).withColumnRenamed("node", "first")
    d = graph.node_numbers(d, ["fid"], S.skipped(F.col("ikind")), existing="old")
    return d.select("fid", "seq", F.coalesce("first", F.lit(0)).cast("int").alias("node"), F.coalesce("node", F.lit(0)).cast("int").alias("kept"))


@query(f"WITH {PROG_SQL} SELECT fid, seq AS node, CAST(row_number() OVER (PARTITION BY fid ORDER BY translate(substr(bin(seq + 1), 2), '01', '10')) - 1 AS INT) AS position FROM ins")
def visiting_order(spark, sf_dir):
    """Reverse post-order of heaps: node i has 2i+1 on its true side and 2i+2 on its false side."""
    p = program(spark, sf_dir).select("fid", "seq")
    e = p.where("seq > 0").select("fid", ((F.col("seq") - 1) / 2).cast("int").alias("src"), F.col("seq").alias("dst"), F.when(F.col("seq") % 2 == 1, 1).otherwise(2).cast("tinyint").alias("label"))
    return graph.visiting_order(p.select("fid").distinct(), e, ["fid"])


# solver

REACH_SQL = "f(fid, node) AS (SELECT DISTINCT fid, 0 FROM pl UNION SELECT be.fid, dst FROM be JOIN f ON f.fid = be.fid AND src = node{where}) SELECT fid, node, unnest(['IN', 'OUT']) AS point, true AS bottom FROM f"


def entries(placed: DataFrame, node: int = 0) -> DataFrame:
    return placed.select("fid", F.lit(node).alias("node")).distinct()


@query(f"WITH RECURSIVE {BLOCK_SQL}, " + REACH_SQL.format(where=""))
def solver_forward(spark, sf_dir):
    placed, e = block_graph(spark, sf_dir)
    return Solver(ForwardBottom(), e, entries(placed), ["fid"]).run()


@query(f"WITH RECURSIVE {BLOCK_SQL}, f(fid, node) AS (SELECT DISTINCT fid, -1 FROM pl UNION SELECT be.fid, src FROM be JOIN f ON f.fid = be.fid AND dst = node) SELECT fid, node, unnest(['IN', 'OUT']) AS point, true AS bottom FROM f")
def solver_backward(spark, sf_dir):
    placed, e = block_graph(spark, sf_dir)
    return Solver(BackwardBottom(), e, entries(placed, graph.EXIT), ["fid"]).run()


@query(f"WITH RECURSIVE {BLOCK_SQL}, f(fid, node) AS (SELECT DISTINCT fid, 0 FROM pl UNION SELECT be.fid, dst FROM be JOIN f ON f.fid = be.fid AND src = node WHERE (be.fid, src) NOT IN (SELECT (fid, bb) FROM pl WHERE ikind = 12)) "
       "SELECT fid, node FROM f")
def solver_skip_calls(spark, sf_dir):
    """Facts don't pass blocks with calls; the result is read through the context."""
    placed, e = block_graph(spark, sf_dir)
    calls = placed.where("ikind = 12").select("fid", F.col("bb").alias("node")).distinct()
    solver = Solver(ForwardBottom(), e, entries(placed), ["fid"], context=Context(function="f:main"), skip_calls=calls)
    solver.run()
    return solver.context.get("forward-bottom").where("point = 'IN'").select("fid", "node")


CHUNK_SQL = PROG_SQL + ", ch AS (SELECT fid, CAST(seq // 8 AS BIGINT) AS chunk, seq % 8 AS node, t, k FROM ins)"


def chunks(spark, sf_dir) -> DataFrame:
    """Short functions: eight events of a user in a row."""
    return program(spark, sf_dir).select("fid", F.expr("seq div 8").alias("chunk"), F.expr("seq % 8").alias("node"), "t", "k")


def in_a_row(c: DataFrame) -> DataFrame:
    return c.where("node > 0").select("fid", "chunk", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))


class Sums(Analysis):
    """Views set a, clicks set b, purchases set c = a + b: two facts at once."""

    name, keys, values = "sums", ("var",), ("v",)

    def __init__(self, insn: DataFrame) -> None:
        self.insn = insn

    def boundary(self, nodes):
        return nodes.withColumns({"var": F.lit(""), "v": F.lit(0).cast("bigint")}).where("false")

    def effects(self, nodes):
        var = F.when(F.col("t") == "view", "a").when(F.col("t") == "click", "b")
        return self.insn.select("fid", "chunk", "node", var.alias("var"), F.col("k").alias("v")).where("var is not null")

    def transfer(self, facts):
        j = facts.join(self.insn.select("fid", "chunk", "node", "t"), ["fid", "chunk", "node"])
        passed = j.where("not ((t = 'view' and var = 'a') or (t = 'click' and var = 'b') or (t = 'purchase' and var = 'c'))")
        known = [F.max(F.when(F.col("var") == x, F.col("v"))).alias(x) for x in "ab"]
        made = j.where("t = 'purchase'").groupBy("fid", "chunk", "node").agg(*known).where("a is not null and b is not null")
        made = made.select("fid", "chunk", "node", F.lit("c").alias("var"), (F.col("a") + F.col("b")).alias("v"))
        return passed.select(made.columns).unionByName(made)

    def meet(self):
        return [F.max("v").alias("v")]


SUMS_SQL = f"""WITH {CHUNK_SQL}, s AS (SELECT *, last_value(CASE WHEN t = 'view' THEN k END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN t = 'click' THEN k END IGNORE NULLS) OVER w AS b
 FROM ch WINDOW w AS (PARTITION BY fid, chunk ORDER BY node ROWS UNBOUNDED PRECEDING)),
 u AS (SELECT *, last_value(CASE WHEN t = 'purchase' THEN a + b END IGNORE NULLS) OVER (PARTITION BY fid, chunk ORDER BY node ROWS UNBOUNDED PRECEDING) AS c FROM s)
 SELECT * FROM (SELECT fid, chunk, node, 'a' AS var, a AS v FROM u UNION ALL SELECT fid, chunk, node, 'b', b FROM u UNION ALL SELECT fid, chunk, node, 'c', c FROM u) x WHERE v IS NOT NULL"""


def sums(spark, sf_dir, **how) -> DataFrame:
    c = chunks(spark, sf_dir)
    ends = c.where("node = 0").select("fid", "chunk", "node")
    return Solver(Sums(c), in_a_row(c), ends, ["fid", "chunk"], **how).run().where("point = 'OUT'").drop("point")


@query(SUMS_SQL)
def solver_two_facts(spark, sf_dir):
    return sums(spark, sf_dir)


@query(SUMS_SQL)
def solver_replace(spark, sf_dir):
    """The same where new values replace old ones; every node has one predecessor."""
    return sums(spark, sf_dir, meet_at_blocks=False)


class Sides(Analysis):
    """Clicks set v; errors are conditions that say v = 100 + k on their true side."""

    name, values, branches = "sides", ("v",), True

    def __init__(self, insn: DataFrame) -> None:
        self.insn = insn

    def boundary(self, nodes):
        return nodes.withColumn("v", F.lit(0).cast("bigint"))

    def transfer(self, facts):
        j = facts.join(self.insn, ["fid", "chunk", "node"])
        v = F.when(F.col("t") == "click", F.col("k")).otherwise(F.col("v"))
        row = lambda label, value: F.struct(F.lit(label).cast("int").alias("label"), value.alias("v"))
        out = F.when(F.col("t") == "error", F.array(row(1, F.col("k") + 100), row(2, F.col("v")))).otherwise(F.array(row(None, v)))
        return j.select("fid", "chunk", "node", F.inline(out))

    def meet(self):
        return [F.max("v").alias("v")]


@query(f"""WITH RECURSIVE {CHUNK_SQL}, ce AS (SELECT fid, chunk, node AS src, node + 1 AS dst, CASE WHEN t = 'error' THEN 1 ELSE 0 END AS label FROM ch UNION ALL SELECT fid, chunk, node, node + 2, 2 FROM ch WHERE t = 'error'),
 f(fid, chunk, node, v) AS (SELECT fid, chunk, 0, CAST(0 AS BIGINT) FROM ch WHERE node = 0 UNION
 SELECT f.fid, f.chunk, n.node, CASE WHEN ch.t = 'click' THEN ch.k WHEN ce.label = 1 THEN 100 + ch.k ELSE f.v END FROM f JOIN ch ON ch.fid = f.fid AND ch.chunk = f.chunk AND ch.node = f.node
 JOIN ce ON ce.fid = f.fid AND ce.chunk = f.chunk AND ce.src = f.node JOIN ch n ON n.fid = f.fid AND n.chunk = f.chunk AND n.node = ce.dst),
 m AS (SELECT fid, chunk, node, max(v) AS v FROM f GROUP BY 1, 2, 3), o AS (SELECT m.*, ch.t, ch.k FROM m JOIN ch ON ch.fid = m.fid AND ch.chunk = m.chunk AND ch.node = m.node)
 SELECT fid, chunk, node, 'IN' AS point, v FROM m UNION ALL SELECT fid, chunk, node, 'OUT', CASE WHEN t = 'click' THEN k ELSE v END FROM o WHERE t <> 'error' UNION ALL
 SELECT fid, chunk, node, 'TRUEOUT', 100 + k FROM o WHERE t = 'error' UNION ALL SELECT fid, chunk, node, 'FALSEOUT', v FROM o WHERE t = 'error'""")
def solver_branches(spark, sf_dir):
    """True sides go one on, false sides two."""
    c = chunks(spark, sf_dir)
    n = c.select("fid", "chunk", F.col("node").alias("dst"))
    e = c.select("fid", "chunk", F.col("node").alias("src"), F.explode(F.when(F.col("t") == "error", F.array(F.struct(F.lit(1), F.lit(1)), F.struct(F.lit(2), F.lit(2)))).otherwise(F.array(F.struct(F.lit(1), F.lit(0))))).alias("_e"))
    e = e.select("fid", "chunk", "src", (F.col("src") + F.col("_e.col1")).alias("dst"), F.col("_e.col2").alias("label")).join(n, ["fid", "chunk", "dst"], "left_semi")
    return Solver(Sides(c), e, c.where("node = 0").select("fid", "chunk", "node"), ["fid", "chunk"]).run()


@query(f"""WITH {CHUNK_SQL}, h AS (SELECT fid, chunk, min(CASE WHEN t = 'view' AND node > 0 THEN node END) AS h FROM ch GROUP BY 1, 2)
 SELECT ch.fid, ch.chunk, node, CAST(CASE WHEN node >= h THEN -2147483648 ELSE node END AS BIGINT) AS lo, CAST(CASE WHEN node >= h THEN 2147483647 ELSE node END AS BIGINT) AS hi FROM ch JOIN h ON h.fid = ch.fid AND h.chunk = ch.chunk""")
def interval_loops(spark, sf_dir):
    """x = 0, then x = x + 1 at every node; the last node leads back to the first view after the entry, where x widens."""
    c = chunks(spark, sf_dir)
    fn = ["fid", "chunk"]
    none = F.lit(None)
    a = c.select(*fn, "node", F.lit("x").alias("var"), F.when(F.col("node") == 0, int(X.VAL)).otherwise(int(X.ADD)).alias("xkind"), F.when(F.col("node") > 0, "x").alias("a_var"), F.when(F.col("node") == 0, 0).cast("bigint").alias("a_const"),
                 none.cast("string").alias("b_var"), F.when(F.col("node") > 0, 1).cast("bigint").alias("b_const"), F.lit(False).alias("weak"))
    back = c.groupBy(*fn).agg(F.max("node").alias("src"), F.min(F.when((F.col("t") == "view") & (F.col("node") > 0), F.col("node"))).alias("dst")).where("dst is not null")
    entry = c.limit(0).select(*fn, "node", F.lit("x").alias("var"), F.col("k").alias("lo"), F.col("k").alias("hi"))
    return analyses.interval(a, in_a_row(c).unionByName(back), fn, entry=entry, full=(-(2**31), 2**31 - 1)).select(*fn, "node", "lo", "hi")


@query("""SELECT p_partkey AS f, node, var, CAST(CASE WHEN var = 't' THEN 0 WHEN var = 'y' THEN 0 WHEN node = 3 THEN 1 WHEN node = 4 THEN p_size ELSE 0 END AS BIGINT) AS lo,
 CAST(CASE WHEN var = 't' THEN 1 WHEN var = 'y' THEN 0 WHEN node = 0 THEN 0 ELSE p_size END AS BIGINT) AS hi FROM part, (SELECT unnest([0, 1, 1, 2, 2, 3, 3, 4, 4, 4]) AS node, unnest(['x', 'x', 't', 'x', 't', 'x', 't', 'x', 't', 'y']) AS var) v""")
def interval_counted_loops(spark, sf_dir):
    """x = 0; while (t = x < size) x = x + 1; y = x - size, for every part: widened at loop heads only, bounded by the branch, narrowed to the exact bound."""
    t, fn = Tables(spark), ["f"]
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("f"), F.col("p_size").cast("bigint").alias("n"))
    row = lambda node, var, kind, a, ac, b, bc: F.struct(F.lit(node).alias("node"), F.lit(var).alias("var"), F.lit(int(kind)).alias("xkind"), F.lit(a).cast("string").alias("a_var"), ac.cast("bigint").alias("a_const"), F.lit(b).cast("string").alias("b_var"), bc.cast("bigint").alias("b_const"), F.lit(False).alias("weak"))
    none, n = F.lit(None), F.col("n")
    a = t.keep(p.select("f", F.inline(F.array(row(0, "x", X.VAL, None, F.lit(0), None, none), row(1, "t", X.LT, "x", none, None, n), row(3, "x", X.ADD, "x", none, None, F.lit(1)), row(4, "y", X.SUB, "x", none, None, n)))))
    edge = lambda s, d, label: F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"), F.lit(label).alias("label"))
    e = t.keep(p.select("f", F.inline(F.array(edge(0, 1, 0), edge(1, 2, 0), edge(2, 3, 1), edge(3, 1, 0), edge(2, 4, 2)))))
    # the comparison is before the branch on every way, though not before the loop's head
    with t:
        branches = t.keep(p.select("f", F.lit(2).alias("node"), F.lit("t").alias("var")))
        conditions = t.keep(analyses.comparisons(branches, a, e, fn))
        entry = a.limit(0).select("f", "node", "var", F.col("a_const").alias("lo"), F.col("a_const").alias("hi"))
        return analyses.interval(a, e, fn, entry=entry, full=(-(2**31), 2**31 - 1), refine=analyses.branch_limits(conditions, fn), heads=graph.loop_heads(e, fn), widen_after=2, narrow=16)


@query(f"""WITH RECURSIVE {BLOCK_SQL}, us AS (SELECT fid, bb, seq, k % 5 AS var, ikind = 7 AS is_def FROM pl WHERE ikind IN (7, 12, 14)), fe AS (SELECT fid, bb, var, arg_min(is_def, seq) AS kills FROM us GROUP BY 1, 2, 3),
 en(fid, bb, var) AS (SELECT fid, bb, var FROM fe WHERE NOT kills UNION SELECT be.fid, be.src, en.var FROM en JOIN be ON be.fid = en.fid AND be.dst = en.bb LEFT JOIN fe ON fe.fid = be.fid AND fe.bb = be.src AND fe.var = en.var AND fe.kills WHERE fe.fid IS NULL),
 lo AS (SELECT DISTINCT be.fid, be.src AS bb, var FROM be JOIN en ON en.fid = be.fid AND en.bb = be.dst), g AS (SELECT pl.fid, pl.bb, pl.seq, v.var, us.is_def FROM pl CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS var) v
 LEFT JOIN us ON us.fid = pl.fid AND us.seq = pl.seq AND us.var = v.var), n AS (SELECT *, first_value(is_def IGNORE NULLS) OVER (PARTITION BY fid, bb, var ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM g)
 SELECT n.fid, n.seq, n.var FROM n LEFT JOIN lo ON lo.fid = n.fid AND lo.bb = n.bb AND lo.var = n.var WHERE CASE WHEN nd IS NULL THEN lo.fid IS NOT NULL ELSE NOT nd END""")
def live_blocks(spark, sf_dir):
    """Assignments define k mod 5, calls and conditions use it; over all blocks."""
    placed, e = block_graph(spark, sf_dir)
    uses = placed.where("ikind in (7, 12, 14)").select("fid", "bb", "seq", F.expr("k % 5").alias("var"), (F.col("ikind") == 7).alias("is_def"))
    return analyses.liveness(placed.select("fid", "bb", "seq"), uses, e, ["fid"])


@query("""WITH k AS (SELECT o_orderkey AS n, o_orderpriority = '5-LOW' AS st, o_orderstatus = 'P' AS br FROM orders),
 w AS (SELECT n, max(CASE WHEN st THEN n END) OVER (ORDER BY n) AS s, max(CASE WHEN br OR nx IS NULL THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
 FROM (SELECT *, CASE WHEN lead(n) OVER (ORDER BY n) = n + 1 THEN 1 END AS nx FROM k) x) SELECT n AS node FROM w WHERE s > coalesce(b, -1)""")
def reach_long_chains(spark, sf_dir):
    """Each order leads to the next number, but pending ones; low priorities are starts.  Chains are as long as there are orders between pending ones."""
    o = table(spark, sf_dir, "orders")
    n = o.select(F.col("o_orderkey").alias("dst"))
    e = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")).join(n, "dst", "left_semi")
    return analyses.reach_contracted(e, o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("node")))


@query(f"""WITH RECURSIVE {BLOCK_SQL}, gk AS (SELECT fid, bb, seq, k % 5 AS var, ikind = 7 AS made FROM pl WHERE ikind IN (7, 12)), la2 AS (SELECT fid, bb, var, arg_max(made, seq) AS made FROM gk GROUP BY 1, 2, 3),
 i(fid, bb, var) AS (SELECT be.fid, be.dst, var FROM la2 JOIN be ON be.fid = la2.fid AND be.src = la2.bb WHERE made UNION SELECT be.fid, be.dst, i.var FROM i JOIN be ON be.fid = i.fid AND be.src = i.bb LEFT JOIN la2 ON la2.fid = i.fid AND la2.bb = i.bb AND la2.var = i.var WHERE la2.fid IS NULL),
 g AS (SELECT pl.fid, pl.bb, pl.seq, v.var, gk.made FROM pl CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS var) v LEFT JOIN gk ON gk.fid = pl.fid AND gk.seq = pl.seq AND gk.var = v.var),
 o AS (SELECT *, last_value(made IGNORE NULLS) OVER (PARTITION BY fid, bb, var ORDER BY seq) AS af, last_value(made IGNORE NULLS) OVER (PARTITION BY fid, bb, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM g)
 SELECT o.fid, seq AS node, point, o.var FROM (SELECT fid, bb, seq, var, 'IN' AS point, bf AS m FROM o UNION ALL SELECT fid, bb, seq, var, 'OUT', af FROM o) o LEFT JOIN i ON i.fid = o.fid AND i.bb = o.bb AND i.var = o.var WHERE coalesce(m, i.fid IS NOT NULL)""")
def solver_blocks(spark, sf_dir):
    """Assignments of k mod 5 that may reach a node; calls end them.  Block transfers are composed, rounds follow blocks."""
    with Tables(spark) as t:
        placed, e = kept_graph(t, spark, sf_dir)
        events = placed.where("ikind in (7, 12)").select("fid", F.col("seq").alias("node"), F.expr("k % 5").alias("var"), (F.col("ikind") == 7).alias("made"))
        solver = Solver(GenKill(events, ["fid"]), e.where("dst >= 0"), entries(placed), ["fid"], blocks=placed.select("fid", "bb", F.col("seq").alias("node")))
        return solver.run().select("fid", "node", "point", "var")


@query(f"""WITH RECURSIVE {BLOCK_SQL}, i AS (SELECT fid, seq AS src, lead(seq) OVER (PARTITION BY fid, bb ORDER BY seq) AS dst, 0 AS label FROM pl), b AS (SELECT fid, bb, min(seq) AS f, max(seq) AS l FROM pl GROUP BY 1, 2),
 ie AS (SELECT fid, src, dst, CAST(label AS TINYINT) AS label FROM i WHERE dst IS NOT NULL UNION ALL SELECT be.fid, p.l, q.f, be.label FROM be JOIN b p ON p.fid = be.fid AND p.bb = be.src JOIN b q ON q.fid = be.fid AND q.bb = be.dst),
 sk AS (SELECT fid, seq FROM pl WHERE ikind IN (13, 15)), t(fid, src, dst, label) AS (SELECT fid, src, dst, label FROM ie WHERE (fid, src) NOT IN (SELECT (fid, seq) FROM sk)
 UNION SELECT t.fid, t.src, ie.dst, t.label FROM t JOIN ie ON ie.fid = t.fid AND ie.src = t.dst WHERE (t.fid, t.dst) IN (SELECT (fid, seq) FROM sk)) SELECT DISTINCT * FROM t WHERE (fid, dst) NOT IN (SELECT (fid, seq) FROM sk)""")
def contract_skips(spark, sf_dir):
    """Instruction graphs without labels and gotos, which form chains and cycles."""
    placed, e = block_graph(spark, sf_dir)
    drop = placed.where(S.skipped(F.col("ikind"))).select("fid", F.col("seq").alias("node"))
    return graph.contract(graph.insn_edges(placed, e, ["fid"]), drop, ["fid"])


DOM_SQL = BLOCK_SQL + """, g AS (SELECT DISTINCT fid, src, dst FROM be), f(fid, node) AS (SELECT DISTINCT fid, 0 FROM pl UNION SELECT g.fid, dst FROM g JOIN f ON f.fid = g.fid AND src = node),
 av(fid, d, node) AS (SELECT fid, node, 0 FROM f WHERE node <> 0 UNION SELECT g.fid, d, dst FROM g JOIN av ON av.fid = g.fid AND src = node WHERE dst <> d),
 dm AS (SELECT n.fid, n.node, d.node AS d FROM f n JOIN f d ON d.fid = n.fid AND d.node <> n.node WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.fid = n.fid AND av.d = d.node AND av.node = n.node))"""


@query(f"""WITH RECURSIVE {DOM_SQL}, c AS (SELECT fid, node, count(*) AS c FROM dm GROUP BY 1, 2) SELECT dm.fid, dm.node, CAST(arg_max(dm.d, coalesce(c.c, 0)) AS INT) AS idom
 FROM dm LEFT JOIN c ON c.fid = dm.fid AND c.node = dm.d GROUP BY dm.fid, dm.node""")
def dominator_tree(spark, sf_dir):
    """The immediate dominator of every block that its function's first block reaches, the exit too."""
    placed, e = block_graph(spark, sf_dir)
    return dominance.dominators(e, entries(placed), ["fid"])


@query(f"""WITH RECURSIVE {DOM_SQL}, x AS (SELECT fid, node, d FROM dm UNION ALL SELECT fid, node, node FROM f),
 df AS (SELECT DISTINCT g.fid, x.d AS node, g.dst AS jn FROM g JOIN x ON x.fid = g.fid AND x.node = g.src LEFT JOIN dm ON dm.fid = g.fid AND dm.node = g.dst AND dm.d = x.d WHERE dm.fid IS NULL),
 ph(fid, var, node) AS (SELECT DISTINCT pl.fid, k % 5, df.jn FROM pl JOIN df ON df.fid = pl.fid AND df.node = pl.bb WHERE ikind = 7 UNION SELECT df.fid, var, df.jn FROM ph JOIN df ON df.fid = ph.fid AND df.node = ph.node)
 SELECT fid, var, node FROM ph""")
def phi_nodes(spark, sf_dir):
    """Blocks where assignments of k mod 5 meet, and those where they meet again."""
    placed, e = block_graph(spark, sf_dir)
    e, at = Tables(spark).keep(e), entries(placed)
    front = dominance.frontiers(e, dominance.dominators(e, at, ["fid"]), at, ["fid"])
    return dominance.phi_places(placed.where("ikind = 7").select("fid", F.expr("k % 5").alias("var"), F.col("bb").alias("node")), front, ["fid"])


@query(f"""WITH RECURSIVE {BLOCK_SQL}, f(fid, node) AS (SELECT DISTINCT fid, 0 FROM pl UNION SELECT be.fid, dst FROM be JOIN f ON f.fid = be.fid AND src = node), b(fid, node) AS (SELECT DISTINCT fid, -1 FROM pl UNION SELECT be.fid, src FROM be JOIN b ON b.fid = be.fid AND dst = node)
 SELECT fid, node, 'forward' AS way FROM f UNION ALL SELECT fid, node, 'backward' FROM b""")
def lock_step(spark, sf_dir):
    """Two analyses grow together, a round of both at a time."""
    with Tables(spark) as t:
        placed, e = kept_graph(t, spark, sf_dir)
        hop = t.keep(e.select("fid", "src", "dst").distinct())
        step = lambda way, a, b: lambda t: t[way].join(hop.select("fid", F.col(a).alias("node"), F.col(b).alias("_n")), ["fid", "node"]).select("fid", F.col("_n").alias("node"))
        got = close_together({"forward": entries(placed), "backward": entries(placed, graph.EXIT)}, {"forward": step("forward", "src", "dst"), "backward": step("backward", "dst", "src")}, distributive=True)
    return got["forward"].withColumn("way", F.lit("forward")).unionByName(got["backward"].withColumn("way", F.lit("backward")))


@query(f"""WITH RECURSIVE {BLOCK_SQL}, f(fid, node) AS (SELECT DISTINCT fid, 0 FROM pl UNION SELECT be.fid, dst FROM be JOIN f ON f.fid = be.fid AND src = node), c AS (SELECT be.* FROM be JOIN f a ON a.fid = be.fid AND a.node = src JOIN f z ON z.fid = be.fid AND z.node = dst),
 b(fid, node) AS (SELECT DISTINCT fid, -1 FROM pl UNION SELECT c.fid, src FROM c JOIN b ON b.fid = c.fid AND dst = node) SELECT fid, node FROM b""")
def staged_analyses(spark, sf_dir):
    """What leads to the exit, over the graph that the first stage left."""
    placed, e = block_graph(spark, sf_dir)
    done = run_staged([("reached", lambda c: analyses.reach(e, entries(placed), ["fid"])), ("graph", lambda c: views.cascade(e, c.get("reached"), ["fid"])),
                       ("exits", lambda c: analyses.reach(c.get("graph"), entries(placed, graph.EXIT), ["fid"], backward=True))])
    return done.get("exits")


@query("SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN CAST(n_nationkey AS BIGINT) WHEN c_custkey % 3 = 1 THEN 7 ELSE 7 + CAST(c_nationkey AS BIGINT) END AS v FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def cooperating(spark, sf_dir):
    """x = *p: where p's only target is known (its nation) the copy offers x = target; where x is known to be 7 constants offer x = 7; the first in the policy counts."""
    c = table(spark, sf_dir, "customer")
    insn = c.select(F.col("c_custkey").alias("node"), F.lit("deref").alias("op"), F.col("c_nationkey").cast("bigint").alias("v"))
    pointee = lambda now: now.where("op = 'deref' and node % 3 <> 1").select("node", "v")
    constant = lambda now: now.where("op = 'deref' and node % 3 <> 0 or op = 'copy' and node % 3 = 2").select("node", "op", "v")

    def view(facts):
        one = facts["points-to"].select("node", F.lit("copy").alias("op"), "v", F.lit("points-to").alias("offer"))
        two = facts["constants"].select("node", F.lit("const").alias("op"), F.when(F.expr("node % 3 = 1"), F.lit(7).cast("bigint")).otherwise(F.col("v") + 7).alias("v"), F.lit("constants").alias("offer"))
        return one.unionByName(two)

    _, now = run_cooperating(view, {"points-to": pointee, "constants": constant}, insn, ["points-to", "constants"])
    return now.select("node", "v")


# clients: instruction tables of customers' orders

INSN_SQL = """en AS (SELECT p_partkey AS eid, [1, 2, 8, 9, 12, 3][p_partkey % 6 + 1] AS ekind, CASE WHEN p_partkey % 7 = 0 THEN 25 ELSE 4 END AS vkind, CAST(p_size AS BIGINT) AS number FROM part),
 inn AS (SELECT l_orderkey AS fid, l_linenumber AS seq, l_partkey AS a, l_suppkey AS b, CASE l_linenumber WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 10 WHEN 5 THEN 12 WHEN 6 THEN 16 ELSE 4 END AS ikind,
 l_partkey % 3 AS m, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn FROM lineitem)"""


def unit_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines as instructions over parts as entities: (insn, entity)."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(int(x)) for x in (E.VAR_GLBL, E.VAR_LOCL, E.LIT_NUM, E.LIT_NUM_IMM, E.FUNC, E.VAR_LOCL_ARG)])
    entity = p.select(F.lit(1).cast("bigint").alias("tu_id"), F.col("p_partkey").alias("eid"), F.get(kinds, F.expr("cast(p_partkey % 6 as int)")).alias("ekind"),
                      F.when(F.expr("p_partkey % 7 = 0"), 25).otherwise(4).alias("vkind"), F.col("p_size").cast("decimal(20,0)").alias("low_val"))
    n = F.col("l_linenumber")
    kind = F.when(n == 1, 7).when(n == 2, 8).when(n == 3, 9).when(n == 4, 10).when(n == 5, 12).when(n == 6, 16).otherwise(4)
    expr = lambda k, a, b=F.lit(None), args=F.array(): F.struct(k.cast("int").alias("xkind"), a.cast("bigint").alias("op1"), b.cast("bigint").alias("op2"), args.cast("array<bigint>").alias("args"))
    a, b, m = F.col("l_partkey"), F.col("l_suppkey"), F.expr("l_partkey % 3")
    one = F.when(n == 3, expr(F.when(m == 0, int(X.DEREF)).otherwise(int(X.ARR_INDX)), a, b)).when(n == 5, expr(F.lit(int(X.CALL)), a, args=F.array(b))).when(n < 6, expr(F.lit(1), a)).when(n == 6, expr(F.lit(1), b))
    two = (F.when(n.isin(1, 3), expr(F.lit(1), b)).when(n == 2, expr(F.when(m == 0, int(X.ADD)).when(m == 1, int(X.ADDROF)).otherwise(int(X.DEREF)), b, F.when(m == 0, a)))
           .when(n == 4, expr(F.lit(int(X.CALL)), F.lit(-5), args=F.array(b))))
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit(1).cast("bigint").alias("tu_id"), F.col("l_orderkey").alias("fid"), n.cast("int").alias("seq"), kind.alias("ikind"), one.alias("expr1"), two.alias("expr2")), entity


@query(f"""WITH {INSN_SQL}, v AS (SELECT eid FROM en WHERE ekind BETWEEN 1 AND 7), g AS (SELECT eid FROM en WHERE ekind = 1),
 s AS (SELECT fid, seq, NULL AS target, unnest(CASE ikind WHEN 9 THEN [a, CASE WHEN m IS NOT NULL THEN b END, b] WHEN 12 THEN [a, b] WHEN 16 THEN [b] END) AS source, true AS always FROM inn WHERE ikind IN (9, 12, 16)
 UNION ALL SELECT fid, seq, NULL, b, true FROM inn WHERE ikind = 10 UNION ALL SELECT fid, seq, a, unnest(CASE WHEN ikind = 8 AND m = 0 THEN [b, a] ELSE [b] END), false FROM inn WHERE ikind IN (7, 8)),
 r AS (SELECT DISTINCT s.* FROM s JOIN v ON v.eid = s.source UNION SELECT fid, seq, NULL, eid, true FROM inn, g WHERE ikind IN (10, 12) UNION SELECT fid, seq, a, NULL, false FROM inn WHERE ikind IN (7, 8, 10) UNION SELECT fid, seq, -1, NULL, false FROM inn WHERE ikind = 4)
 SELECT CAST(coalesce(target, -2) AS BIGINT) AS target, always, count(*) AS n, CAST(coalesce(sum(source), 0) AS BIGINT) AS sources, CAST(sum(fid * 10 + seq) AS BIGINT) AS nodes FROM r GROUP BY 1, 2""")
def client_liveness(spark, sf_dir):
    """What each instruction reads and writes, added up by target; a call's row for all globals counts as often as there are globals, each once.

    Sums are decimals up to the last cast, as SQL adds in 128 bits: a total that doesn't fit its type is an error there, too, a part of one is none.
    """
    insn, entity = unit_tables(spark, sf_dir)
    d = clients.liveness_effects(insn, entity, globals_as_one=True)
    wide = lambda c: c.cast("decimal(38,0)")
    many = clients.globals_of(entity).distinct().groupBy("tu_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(wide(F.col("var"))).alias("_sum"))
    d = d.withColumn("_all", F.col("source").eqNullSafe(analyses.UNIVERSE)).join(F.broadcast(many), "tu_id", "left").where("not _all or _n is not null")
    n = F.when(F.col("_all"), F.col("_n")).otherwise(1)
    source = F.when(F.col("_all"), F.col("_sum")).otherwise(F.col("source"))
    place = F.col("fid") * 10 + F.col("node")
    sums = [F.sum(n).alias("n"), F.coalesce(F.sum(wide(source)), F.lit(0)).cast("bigint").alias("sources"), F.sum(wide(place) * n).cast("bigint").alias("nodes")]
    return d.groupBy(F.coalesce("target", F.lit(-2)).alias("target"), "always").agg(*sums)


@query(f"""WITH RECURSIVE {INSN_SQL}, v AS (SELECT eid FROM en WHERE ekind BETWEEN 1 AND 7), g AS (SELECT eid FROM en WHERE ekind = 1),
 s AS (SELECT fid, seq, CAST(NULL AS BIGINT) AS target, unnest(CASE ikind WHEN 9 THEN [a, b] WHEN 12 THEN [a, b] WHEN 16 THEN [b] WHEN 10 THEN [b] END) AS source FROM inn WHERE ikind IN (9, 10, 12, 16)
 UNION ALL SELECT fid, seq, a, unnest(CASE WHEN ikind = 8 AND m = 0 THEN [b, a] ELSE [b] END) FROM inn WHERE ikind IN (7, 8)), es AS (SELECT DISTINCT s.* FROM s JOIN v ON v.eid = s.source),
 kl AS (SELECT DISTINCT fid, seq AS node, a AS var FROM inn WHERE ikind IN (7, 8, 10)), ka AS (SELECT DISTINCT fid, seq AS node FROM inn WHERE ikind = 4),
 mg AS (SELECT DISTINCT fid, eid AS var FROM (SELECT fid, a AS eid FROM inn UNION SELECT fid, b FROM inn) x WHERE eid IN (SELECT eid FROM g) UNION SELECT DISTINCT fid, -2 FROM inn),
 own AS (SELECT DISTINCT kl.fid, var FROM kl JOIN g ON eid = var), ex AS (SELECT fid, max(seq) AS node FROM inn GROUP BY fid),
 nx AS (SELECT DISTINCT fid, seq AS src, (SELECT min(z.seq) FROM inn z WHERE z.fid = inn.fid AND z.seq > inn.seq) AS dst FROM inn), ed AS (SELECT fid, src, coalesce(dst, 99) AS dst FROM nx),
 li(fid, node, var) AS (SELECT * FROM (SELECT fid, seq, source FROM es WHERE target IS NULL UNION SELECT i.fid, i.seq, mg.var FROM inn i JOIN mg ON mg.fid = i.fid WHERE ikind IN (10, 12) UNION SELECT ex.fid, 99, mg.var FROM ex JOIN mg ON mg.fid = ex.fid WHERE ex.fid <> (SELECT min(fid) FROM inn)) q
 UNION SELECT ed.fid, ed.src, CASE WHEN kl.var IS NULL THEN li.var ELSE es.source END FROM li JOIN ed ON ed.fid = li.fid AND ed.dst = li.node LEFT JOIN kl ON kl.fid = ed.fid AND kl.node = ed.src AND kl.var = li.var
 LEFT JOIN es ON es.fid = ed.fid AND es.seq = ed.src AND es.target = li.var LEFT JOIN ka ON ka.fid = ed.fid AND ka.node = ed.src WHERE ka.node IS NULL AND (kl.var IS NULL OR es.source IS NOT NULL))
 SELECT fid, node, var FROM li WHERE node <> 99 AND NOT (var IN (SELECT eid FROM g) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.fid = li.fid AND o.var = li.var) AND EXISTS (SELECT 1 FROM li z WHERE z.fid = li.fid AND z.node = li.node AND z.var = -2))""")
def client_live_facts(spark, sf_dir):
    """From instruction rows to facts: strongly live variables before each line, globals live at the exits of all functions but the first; -2: all globals that the function doesn't assign."""
    insn, entity = unit_tables(spark, sf_dir)
    fn = ["tu_id", "fid"]
    nodes = insn.select(*fn, F.col("seq").alias("src")).distinct()
    e = nodes.withColumn("dst", F.lead("src").over(Window.partitionBy(*fn).orderBy("src"))).where("dst is not null")
    exits = insn.groupBy(*fn).agg(F.max("seq").alias("node"))
    main = insn.groupBy("tu_id").agg(F.min("fid").alias("fid"))
    live = analyses.strong_liveness(clients.liveness_effects(insn, entity, globals_as_one=True), e, fn, exit_live=clients.exit_live(exits, entity, main, globals_as_one=True), universe=clients.globals_of(entity))
    return live.select("fid", "node", "var")


@query(f"""WITH {INSN_SQL}, j AS (SELECT i.*, x.ekind AS xe, x.vkind AS xv, y.ekind AS ye, y.vkind AS yv, y.number AS yn, x.number AS xn FROM inn i LEFT JOIN en x ON x.eid = a LEFT JOIN en y ON y.eid = b),
 f AS (SELECT fid, seq, a AS var, b, ikind, m, ye, yn, xe, xn, xv, CASE WHEN ikind = 10 OR (ikind = 8 AND m <> 0) THEN 31 WHEN ikind = 8 THEN 2 ELSE 1 END AS xkind FROM j
 WHERE ikind IN (7, 8, 9, 10) AND (xe BETWEEN 1 AND 3) AND (ikind <> 9 OR (m <> 0 AND xv = 25)))
 SELECT fid, seq AS node, var, CAST(xkind AS INT) AS xkind, CASE WHEN xkind <> 31 AND ye BETWEEN 1 AND 3 THEN b ELSE -9 END AS a_var, CASE WHEN xkind = 31 THEN 0 WHEN ye IN (8, 9) THEN yn ELSE -9 END AS a_const,
 CASE WHEN xkind = 2 THEN var ELSE -9 END AS b_var, CAST(CASE WHEN xkind = 31 THEN 0 ELSE -9 END AS BIGINT) AS b_const, xv = 25 AS weak FROM f""")
def client_intervals(spark, sf_dir):
    return clients.interval_assigns(*unit_tables(spark, sf_dir)).drop("tu_id").fillna(-9)


@query(f"""WITH {INSN_SQL}, o AS (SELECT ikind, m, a AS p, b AS o, CASE WHEN ikind = 8 THEN CASE m WHEN 0 THEN 2 WHEN 1 THEN 27 ELSE 26 END ELSE 1 END AS rx, ikind = 9 AND m = 0 AS st FROM inn WHERE ikind BETWEEN 7 AND 9
 UNION ALL SELECT ikind, m, a, a, 2, false FROM inn WHERE ikind = 8 AND m = 0), k AS (SELECT o.*, ekind BETWEEN 1 AND 7 AS var, ekind, vkind = 25 AND rx IN (1, 2) AND ekind BETWEEN 1 AND 7 AS arr FROM o JOIN en ON eid = o.o),
 c AS (SELECT *, (rx = 27 AND var) OR arr OR ekind = 12 AS ad, rx IN (1, 2) AND var AND NOT arr AS cp FROM k)
 SELECT DISTINCT 'address' AS kind, p, o FROM c WHERE ad AND NOT st UNION ALL SELECT DISTINCT 'copy', p, o FROM c WHERE cp AND NOT st UNION ALL SELECT DISTINCT 'load', p, o FROM c WHERE rx = 26 AND var AND NOT st
 UNION ALL SELECT DISTINCT 'store', p, o FROM c WHERE cp AND st""")
def client_pointers(spark, sf_dir):
    got, out = clients.pointer_constraints(*unit_tables(spark, sf_dir)), None
    for kind, d in got.items():
        part = d.select(F.lit(kind).alias("kind"), "p", F.col("x" if kind == "address" else "q").alias("o"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey AS fid, n_nationkey * 10 AS node, p_partkey AS var FROM nation JOIN part ON p_size = 1 WHERE n_name <> (SELECT min(n_name) FROM nation)")
def exit_globals(spark, sf_dir):
    """Nations are functions, the first by name is main; parts of size 1 are globals."""
    n, one = table(spark, sf_dir, "nation"), F.lit(1).cast("bigint").alias("tu_id")
    exits = n.select(one, F.col("n_nationkey").alias("fid"), (F.col("n_nationkey") * 10).alias("node"))
    entity = table(spark, sf_dir, "part").select(one, F.col("p_partkey").alias("eid"), F.when(F.col("p_size") == 1, 1).otherwise(2).alias("ekind"))
    main = n.select(one, F.col("n_nationkey").alias("fid"), F.rank().over(Window.orderBy("n_name")).alias("_r")).where("_r = 1")
    return clients.exit_live(exits, entity, main).drop("tu_id")


# views

@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 8 OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey) THEN 6 ELSE 7 END AS INT) AS ikind FROM lineitem")
def view_dead_assign(spark, sf_dir):
    """Lines assign to their part; the numbers of suppliers are live."""
    insn = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(7).alias("ikind"), F.lit(1).alias("at"))
    live = table(spark, sf_dir, "supplier").select(F.lit(1).alias("at"), F.col("s_suppkey").alias("var"))
    return views.dead_assign(insn, live, ["at"], "l_partkey").select("l_orderkey", "l_linenumber", "ikind")


@query("SELECT s_suppkey, CAST(n_nationkey AS BIGINT) AS i FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5 WHERE s_suppkey % 2 = 0")
def view_literal_index(spark, sf_dir):
    """a[i] for even suppliers, whose i may be any nation of a region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    e = F.struct(F.when(F.expr("s_suppkey % 2 = 0"), int(X.ARR_INDX)).otherwise(int(X.ADD)).alias("xkind"), F.lit(1).cast("bigint").alias("op1"), F.lit(2).cast("bigint").alias("op2"))
    insn = s.select("s_suppkey", F.expr("s_suppkey % 5").alias("r"), e.alias("expr2"))
    v = views.literal_index(insn, n.select(F.col("n_regionkey").cast("bigint").alias("r"), F.col("n_nationkey").cast("bigint").alias("literal")), ["r"], "expr2")
    return v.select("s_suppkey", F.col("expr2.op2").alias("i"))


# calls

@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS site, [CAST(c_nationkey AS BIGINT), c_custkey % 9] AS args FROM customer)
 SELECT c_custkey, site, CAST(i - 1 AS INT) AS pos, args[i] AS arg FROM c, (SELECT unnest([1, 2]) AS i) x""")
def call_sites(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("bigint"), F.expr("c_custkey % 9")).alias("args"))
    return link.call_arguments(c, ["c_custkey"])


@query("""SELECT DISTINCT o_custkey AS caller, CAST(CASE WHEN o_orderkey % 3 = 0 THEN s_suppkey ELSE o_orderkey % 50 END AS BIGINT) AS callee FROM orders LEFT JOIN supplier ON s_nationkey = o_orderkey % 25 AND o_orderkey % 3 = 0
 WHERE o_orderkey % 3 <> 0 OR s_suppkey IS NOT NULL""")
def call_graph_pointers(spark, sf_dir):
    """Every third order calls through its nation's pointer: any supplier there."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    through = F.expr("o_orderkey % 3 = 0")
    calls = o.select(F.col("o_custkey").alias("caller"), F.when(~through, F.expr("o_orderkey % 50")).alias("callee"), F.when(through, F.expr("o_orderkey % 25")).alias("pointer"))
    return link.call_graph(calls, s.select(F.col("s_nationkey").cast("bigint").alias("pointer"), F.col("s_suppkey").alias("callee")))


CALLS_SQL = """r AS (SELECT n_name AS caller, CAST(n_nationkey AS VARCHAR) AS site, lead(n_name, 1) OVER (ORDER BY n_nationkey) AS b, lead(n_name, 4) OVER (ORDER BY n_nationkey) AS c FROM nation),
 ca AS (SELECT caller, site, b AS callee FROM r WHERE b IS NOT NULL UNION ALL SELECT caller, site || 'x', c FROM r WHERE c IS NOT NULL)"""


def nation_calls(spark, sf_dir) -> DataFrame:
    n, w = table(spark, sf_dir, "nation"), Window.orderBy("n_nationkey")  # 25 rows
    r = n.select(F.col("n_name").alias("caller"), F.col("n_nationkey").cast("string").alias("site"), F.lead("n_name", 1).over(w).alias("b"), F.lead("n_name", 4).over(w).alias("c"))
    return r.select("caller", "site", F.col("b").alias("callee")).unionByName(r.select("caller", F.concat("site", F.lit("x")).alias("site"), F.col("c").alias("callee"))).where("callee is not null")


@query(f"""WITH RECURSIVE {CALLS_SQL}, f(function, c1, c2) AS (SELECT n_name, '', '' FROM nation WHERE n_nationkey = 0 UNION SELECT callee, site, c1 FROM ca JOIN f ON caller = function) SELECT function, trim(c1 || ' ' || c2) AS context FROM f""")
def call_contexts(spark, sf_dir):
    """Nations call the next and the fourth on: call strings of two sites."""
    c = nation_calls(spark, sf_dir)
    first = table(spark, sf_dir, "nation").where("n_nationkey = 0").first()["n_name"]
    return link.contexts(c, first, 2).select("function", F.array_join("context", " ").alias("context"))


@query(f"""WITH {CALLS_SQL}, k AS (SELECT caller, CASE WHEN site LIKE '%x' THEN 2 ELSE 1 END AS node, callee FROM ca), n AS (SELECT n_name AS f FROM nation), nm AS (SELECT f, i, f || '@#' || i AS id FROM n, (SELECT unnest(generate_series(0, 3)) AS i) x)
 SELECT a.id AS src, b.id AS dst, 0 AS label FROM nm a JOIN nm b ON a.f = b.f AND b.i = a.i + 1 WHERE NOT EXISTS (SELECT 1 FROM k WHERE caller = a.f AND node = a.i) UNION
 SELECT caller || '@#' || node, callee || '@#0', 0 FROM k UNION SELECT callee || '@#3', caller || '@#' || (node + 1), 0 FROM k""")
def supergraph_edges(spark, sf_dir):
    """Functions of four nodes that call at nodes 1 and 2: one graph without contexts."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("function"))
    e = n.select("function", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("src")).select("function", "src", (F.col("src") + 1).alias("dst"), F.lit(0).alias("label"))
    calls = nation_calls(spark, sf_dir).select(F.col("caller").alias("function"), F.when(F.col("site").endswith("x"), 2).otherwise(1).alias("node"), "callee")
    bounds = n.select("function", F.lit(0).alias("entry"), F.lit(3).alias("exit"))
    return link.supergraph(e, calls, bounds, main="")[0]


# types, entities, names and texts

LOWER = " ".join(f"WHEN {int(v)} THEN '{v.name.lower()}'" for v in ValueKind)
TYPES_SQL = """dt AS (SELECT p_partkey + 1 AS type_id, p_size % 32 AS vkind, p_size AS len, (p_partkey + 1) // 2 AS sub, p_name AS type_name, [p_partkey + 1, p_partkey + 2] AS fop, [(p_partkey + 1) // 2, (p_partkey + 1) // 3] AS fot, p_size % 2 = 0 AS dots FROM part)"""
ENT_SQL = """en AS (SELECT c_custkey AS eid, c_custkey % 16 AS ekind, c_nationkey AS vkind, c_custkey % 1024 AS qtype, c_custkey % 300 AS dte, CAST(floor(abs(c_acctbal)) AS BIGINT) * 300 AS low_val, CASE WHEN c_custkey % 5 = 0 THEN 3 END AS high_val,
 CASE WHEN c_custkey % 3 = 0 THEN c_name END AS str_val, c_custkey % 10 AS parent FROM customer)"""


def data_types(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, half = F.col("p_partkey") + 1, F.expr("(p_partkey + 1) div 2")
    return p.select(F.lit(1).cast("bigint").alias("tu_id"), k.alias("type_id"), F.expr("p_size % 32").alias("vkind"), F.col("p_size").alias("len"), F.lit(8).alias("align"), half.alias("sub_type_eid"), F.col("p_name").alias("type_name"),
                    F.array(k, k + 1).alias("fop_ids"), F.array(half, F.expr("(p_partkey + 1) div 3")).alias("fop_type_eids"), F.expr("p_size % 2 = 0").alias("variadic"))


def entities(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.lit(1).cast("bigint").alias("tu_id"), k.alias("eid"), F.expr("cast(c_custkey % 16 as int)").alias("ekind"), F.col("c_nationkey").alias("vkind"), F.expr("cast(c_custkey % 1024 as int)").alias("qtype"), F.expr("c_custkey % 300").alias("data_type_eid"),
                    (F.floor(F.abs("c_acctbal")) * 300).cast("decimal(20,0)").alias("low_val"), F.when(k % 5 == 0, 3).cast("decimal(20,0)").alias("high_val"), F.when(k % 3 == 0, F.col("c_name")).alias("str_val"), F.expr("c_custkey % 10").alias("parent_eid"))


CLASS_SQL = "CASE WHEN {k} = 24 THEN 'function' WHEN {k} BETWEEN 17 AND 23 THEN 'pointer' WHEN {k} BETWEEN 25 AND 27 THEN 'array' WHEN {k} BETWEEN 28 AND 30 THEN 'record' WHEN {k} <= 16 THEN 'basic' ELSE 'other' END"


@query(f"""WITH {TYPES_SQL}, {ENT_SQL}, j AS (SELECT en.*, dt.len, dt.sub, CASE WHEN dte = 0 THEN en.vkind ELSE coalesce(dt.vkind, en.vkind) END AS vk FROM en LEFT JOIN dt ON type_id = dte)
 SELECT eid, CAST(vk AS INT) AS vkind, {CLASS_SQL.format(k='vk')} AS class, coalesce(len, -1) AS len, coalesce(sub, -1) AS sub_type_eid, CAST(bit_count(qtype) AS INT) AS n_qualifiers, qtype & 16 <> 0 AS is_volatile FROM j""")
def type_entities(spark, sf_dir):
    t = types.entity_types(entities(spark, sf_dir), data_types(spark, sf_dir))
    return t.select("eid", "vkind", "class", "len", "sub_type_eid", F.size("qualifiers").alias("n_qualifiers"), F.array_contains("qualifiers", Qualifier.VOLATILE.name).alias("is_volatile")).fillna(-1)


@query(f"WITH {TYPES_SQL} SELECT type_id, sub AS target FROM dt WHERE vkind BETWEEN 17 AND 27")
def type_targets(spark, sf_dir):
    return types.targets(data_types(spark, sf_dir)).drop("tu_id")


@query(f"WITH {TYPES_SQL} SELECT type_id, CAST(i - 1 AS INT) AS pos, fop[i] AS member, fot[i] AS member_type FROM dt, (SELECT unnest([1, 2]) AS i) x WHERE vkind BETWEEN 28 AND 30 OR vkind = 24")
def type_members(spark, sf_dir):
    return types.members(data_types(spark, sf_dir)).drop("tu_id")


LIT_SQL = "coalesce(str_val, CASE WHEN coalesce(high_val, 0) <> 0 THEN high_val || ' ' || low_val END, CAST(low_val AS VARCHAR))"


@query(f"""WITH {ENT_SQL} SELECT eid, {LIT_SQL} AS text, ekind <> 10 AND coalesce(high_val, 0) = 0 AND CASE WHEN vkind BETWEEN 2 AND 5 THEN low_val BETWEEN -524288 AND 524287 ELSE vkind BETWEEN 1 AND 12 AND low_val BETWEEN 0 AND 1048575 END AS immediate
 FROM en WHERE ekind BETWEEN 8 AND 10""")
def literal_rows(spark, sf_dir):
    return types.literals(entities(spark, sf_dir)).select("eid", "text", "immediate")


@query(f"WITH {ENT_SQL} SELECT eid, ekind, parent AS parent_eid, ekind = 1 AS is_global FROM en WHERE ekind BETWEEN 1 AND 7")
def variable_rows(spark, sf_dir):
    e = entities(spark, sf_dir)
    g = types.global_variables(e).select("eid", F.lit(True).alias("g"))
    return types.variables(e, data_types(spark, sf_dir)).join(g, "eid", "left").select("eid", F.col("ekind").cast("bigint").alias("ekind"), "parent_eid", F.coalesce("g", F.lit(False)).alias("is_global"))


@query(f"WITH {ENT_SQL} SELECT eid, coalesce(str_val, 'label_' || eid) AS name FROM en WHERE ekind = 14")
def label_rows(spark, sf_dir):
    return types.labels(entities(spark, sf_dir)).drop("tu_id")


SUB_SQL = "CASE WHEN ekind BETWEEN 19 AND 23 OR ekind = 14 THEN 0 ELSE vkind END"
IDS_SQL = f"""{TYPES_SQL}, {ENT_SQL}, al AS (SELECT eid, ekind, vkind, 0 AS o FROM en UNION ALL SELECT type_id, 11, vkind, 1 FROM dt WHERE type_id NOT IN (SELECT eid FROM en)),
 pf AS (SELECT *, (CAST(ekind AS BIGINT) << 25) | (CAST({SUB_SQL} AS BIGINT) << 20) AS p FROM al), ids AS (SELECT eid, p | row_number() OVER (PARTITION BY p ORDER BY o, eid) AS id FROM pf)"""


@query(f"WITH {IDS_SQL} SELECT eid, id FROM ids")
def internal_id_rows(spark, sf_dir):
    return types.assign_internal_ids(entities(spark, sf_dir), data_types(spark, sf_dir)).drop("tu_id")


@query(f"WITH {IDS_SQL} SELECT DISTINCT dte AS eid, CASE WHEN dte <= 1 THEN dte ELSE id END AS id FROM en LEFT JOIN ids ON ids.eid = dte")
def internal_id_uses(spark, sf_dir):
    """The internal ids of all types that entities name."""
    e = entities(spark, sf_dir)
    return types.internal_ids(e.select("tu_id", F.col("data_type_eid").alias("eid")), types.assign_internal_ids(e, data_types(spark, sf_dir))).drop("tu_id")


NAMES_SQL = f"""{TYPES_SQL}, {ENT_SQL}, ni AS (SELECT s_suppkey AS eid, 'v:main:' || s_name AS name FROM supplier), al AS (SELECT eid FROM en UNION SELECT eid FROM ni UNION SELECT type_id FROM dt),
 nm AS (SELECT al.eid, coalesce(ni.name, str_val, type_name, CASE WHEN ekind = 14 THEN 'label_' || al.eid END) AS name FROM al LEFT JOIN en ON en.eid = al.eid LEFT JOIN ni ON ni.eid = al.eid LEFT JOIN dt ON type_id = al.eid)"""


def names(spark, sf_dir) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.lit(1).cast("bigint").alias("tu_id"), F.col("s_suppkey").alias("eid"), F.concat(F.lit("v:main:"), "s_name").alias("name"))
    return text.names(entities(spark, sf_dir), known, data_types(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT eid, name FROM nm")
def entity_names(spark, sf_dir):
    return names(spark, sf_dir).drop("tu_id")


@query(f"WITH {NAMES_SQL} SELECT en.eid, CASE WHEN ekind BETWEEN 8 AND 10 THEN {LIT_SQL} ELSE CASE WHEN list_last(string_split(name, ':')) = '' THEN '0name' ELSE list_last(string_split(name, ':')) END END AS text FROM en LEFT JOIN nm ON nm.eid = en.eid")
def operand_texts(spark, sf_dir):
    return text.operand_text(entities(spark, sf_dir), names(spark, sf_dir)).drop("tu_id")


TYPE_TEXT_SQL = f"""{TYPES_SQL}, ch(type_id, cur, tail) AS (SELECT type_id, type_id, '' FROM dt UNION ALL SELECT ch.type_id, dt.sub, CASE WHEN vkind <= 24 THEN '*' ELSE '[' || len || ']' END || tail FROM ch JOIN dt ON dt.type_id = cur WHERE vkind BETWEEN 17 AND 27),
 tt AS (SELECT ch.type_id, CASE WHEN dt.type_id IS NULL THEN 'int32' WHEN vkind BETWEEN 28 AND 30 THEN (CASE vkind {LOWER} END) || ' ' || type_name ELSE CASE vkind {LOWER} END END || tail AS text FROM ch LEFT JOIN dt ON dt.type_id = cur WHERE dt.type_id IS NULL OR vkind NOT BETWEEN 17 AND 27)"""


@query(f"WITH RECURSIVE {TYPE_TEXT_SQL} SELECT * FROM tt")
def type_texts(spark, sf_dir):
    return text.type_text(data_types(spark, sf_dir)).drop("tu_id")


@query(f"WITH RECURSIVE {TYPE_TEXT_SQL} SELECT dt.type_id, type_name || ' {{ ' || coalesce(a.text, 'int32') || ' ' || coalesce(x.p_name, '-') || '; ' || coalesce(b.text, 'int32') || ' ' || coalesce(y.p_name, '-') || ' }}' AS text FROM dt LEFT JOIN tt a ON a.type_id = fot[1] LEFT JOIN tt b ON b.type_id = fot[2] "
       "LEFT JOIN part x ON x.p_partkey = fop[1] LEFT JOIN part y ON y.p_partkey = fop[2] WHERE dt.vkind BETWEEN 28 AND 30")
def record_texts(spark, sf_dir):
    """Structures and unions with fields named like parts."""
    d = data_types(spark, sf_dir)
    named = table(spark, sf_dir, "part").select(F.lit(1).cast("bigint").alias("tu_id"), F.col("p_partkey").alias("eid"), F.col("p_name").alias("name"))
    return text.records_text(d, named, text.type_text(d)).drop("tu_id")


@query(f"WITH RECURSIVE {TYPE_TEXT_SQL} SELECT s_suppkey AS fid, coalesce(r.text, 'int32') || ' ' || s_name || '(' || coalesce(a.text, 'int32') || ', ' || coalesce(b.text, 'int32') || CASE WHEN dots THEN ', ...' ELSE '' END || ')' AS text "
       "FROM supplier JOIN dt ON dt.type_id = s_suppkey + 1 LEFT JOIN tt r ON r.type_id = sub LEFT JOIN tt a ON a.type_id = fot[1] LEFT JOIN tt b ON b.type_id = fot[2]")
def function_texts(spark, sf_dir):
    d = data_types(spark, sf_dir)
    f = table(spark, sf_dir, "supplier").select(F.lit(1).cast("bigint").alias("tu_id"), F.col("s_suppkey").alias("fid"), F.concat(F.lit("f:"), "s_name").alias("fname"), F.lit(None).cast("boolean").alias("is_variadic"), (F.col("s_suppkey") + 1).alias("type_eid"))
    return text.functions_text(f, d, text.type_text(d)).drop("tu_id")


@query(f"WITH RECURSIVE {TYPE_TEXT_SQL.replace(TYPES_SQL, NAMES_SQL)} SELECT en.eid, 'global' AS what, concat_ws(' ', coalesce(tt.text, 'int32'), list_last(string_split(name, ':'))) AS text, CAST(-1 AS BIGINT) AS fid FROM en LEFT JOIN nm ON nm.eid = en.eid LEFT JOIN tt ON tt.type_id = dte WHERE ekind = 1 "
       "UNION ALL SELECT en.eid, 'static', list_last(string_split(name, ':')), parent FROM en LEFT JOIN nm ON nm.eid = en.eid WHERE ekind = 4")
def variable_texts(spark, sf_dir):
    """Globals with their types, static locals with their functions."""
    e, n = entities(spark, sf_dir), names(spark, sf_dir)
    g = text.globals_text(e, n, text.type_text(data_types(spark, sf_dir))).select("eid", F.lit("global").alias("what"), "text", F.lit(-1).cast("bigint").alias("fid"))
    return g.unionByName(text.static_locals(e, n).select("eid", F.lit("static").alias("what"), "text", "fid"))


SYMBOL_SQL = "CASE {x} " + " ".join(f"WHEN {int(k)} THEN '{v}'" for k, v in __import__("meetflow.functions.kinds", fromlist=["SYMBOLS"]).SYMBOLS.items()) + " ELSE '' END"


@query(f"""SELECT p_partkey, CASE WHEN x = 1 THEN a WHEN x = 21 THEN a || '(' || b || ', ' || a || ')' WHEN x = 17 THEN a || '[' || b || ']' WHEN x = 18 THEN '&' || a || '[' || b || ']' WHEN x = 19 THEN a || '.' || b WHEN x = 20 THEN '&' || a || '.' || b
 WHEN x = 22 THEN '(cast)' || a WHEN x BETWEEN 28 AND 30 THEN s || '(' || a || ')' WHEN x BETWEEN 23 AND 27 THEN s || a ELSE a || ' ' || s || ' ' || b END AS text
 FROM (SELECT p_partkey, p_size % 32 AS x, p_brand AS a, p_type AS b, {SYMBOL_SQL.format(x='p_size % 32')} AS s FROM part) q""")
def expression_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.expr_text(F.expr("p_size % 32"), F.col("p_brand"), F.col("p_type"), F.array("p_type", "p_brand")).alias("text"))


@query("""SELECT l_orderkey AS fid, l_linenumber - 1 AS seq, l_partkey AS k, CASE l_linenumber WHEN 1 THEN a || ' = ' || b || ' + ' || a WHEN 2 THEN 'return ' || a WHEN 3 THEN a || ':' WHEN 4 THEN 'goto ' || a WHEN 5 THEN 'if ' || a WHEN 6 THEN 'nop'
 ELSE a || '(' || b || ', ?)' END AS text FROM (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS a, s_name AS b FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3) y JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) q""")
def instruction_texts(spark, sf_dir):
    """Lines as instructions over parts and (negated) suppliers; ids without a text show as ``?``."""
    one = F.lit(1).cast("bigint").alias("tu_id")
    ops = table(spark, sf_dir, "part").select(one, F.col("p_partkey").alias("eid"), F.col("p_brand").alias("text"))
    ops = ops.unionByName(table(spark, sf_dir, "supplier").select(one, (-1 - F.col("s_suppkey")).alias("eid"), F.col("s_name").alias("text")))
    n, a, b = F.col("l_linenumber"), F.col("l_partkey"), -1 - F.col("l_suppkey")
    kind = F.when(n == 1, 8).when(n == 2, 16).when(n == 3, 15).when(n == 4, 13).when(n == 5, 14).when(n == 6, 1).otherwise(12)
    none = F.lit(None).cast("bigint")
    expr = lambda k, x, y, args: F.struct(F.lit(k).alias("xkind"), x.alias("op1"), y.alias("op2"), args.cast("array<bigint>").alias("args"))
    e1 = F.when(n >= 7, expr(int(X.CALL), a, none, F.array(b, F.lit(-(10**9)).cast("bigint")))).otherwise(expr(1, a, none, F.array()))
    # lines of one order and number are told apart by their part
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    li = li.select(one, F.struct("l_orderkey", "l_partkey").alias("fid"), (n - 1).cast("int").alias("seq"), kind.alias("ikind"), e1.alias("expr1"), F.when(n == 1, expr(int(X.ADD), b, a, F.array())).alias("expr2"))
    t = text.insn_text(li, ops)
    return t.select(F.col("fid.l_orderkey").alias("fid"), "seq", F.col("fid.l_partkey").alias("k"), "text")


# lattices

HALF = """h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n, CAST(floor(value) AS BIGINT) AS v FROM events),
 r AS (SELECT user_id, min(CASE WHEN s * 8 <= n AND event_type = 'view' THEN v END) AS alo, max(CASE WHEN s * 8 <= n AND event_type = 'view' THEN v END) AS ahi, min(CASE WHEN s * 8 > n THEN v END) AS blo, max(CASE WHEN s * 8 > n THEN v END) AS bhi FROM h GROUP BY 1)"""


@query(f"""WITH {HALF} SELECT user_id, alo IS NULL AS a_top, blo IS NOT NULL AND blo <= 0 AND bhi >= 100 AS b_bottom, coalesce(alo = blo AND ahi = bhi, false) AS same, CASE WHEN alo IS NULL THEN 'nil_Top' ELSE '[' || alo || ', ' || ahi || ']' END AS a_text,
 CASE WHEN blo <= 0 AND bhi >= 100 THEN 'Bot' ELSE '[' || blo || ', ' || bhi || ']' END AS b_text, least(alo, blo) AS lo, greatest(ahi, bhi) AS hi FROM r""")
def range_tests(spark, sf_dir):
    """Top, bottom, equality, text and hull of ranges of one kind; some users have no early view: top."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumns({"s": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count(F.lit(1)).over(w), "v": F.floor("value")})
    early, late = F.expr("s * 8 <= n and event_type = 'view'"), F.expr("s * 8 > n")
    r = e.groupBy("user_id").agg(*[f(F.when(c, F.col("v"))).alias(name) for name, f, c in (("alo", F.min, early), ("ahi", F.max, early), ("blo", F.min, late), ("bhi", F.max, late))])
    a, b, full = (F.col("alo"), F.col("ahi")), (F.col("blo"), F.col("bhi")), (F.lit(0), F.lit(100))
    lo, hi = ranges.meet(*a, *b)
    kind = F.lit(int(V.INT32))
    return r.select("user_id", ranges.is_top(*a).alias("a_top"), ranges.is_bottom(*b, *full).alias("b_bottom"), ranges.equal(*a, *b).alias("same"), ranges.text(*a).alias("a_text"), ranges.text(*b, *full).alias("b_text"),
                    ranges.of_kind(kind, kind, lo).alias("lo"), hi.alias("hi"))


MAP_SQL = """a AS (SELECT l_suppkey AS o, l_partkey AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2),
 b AS (SELECT l_suppkey AS o, l_partkey AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_linestatus = 'O' OR l_suppkey % 3 = 0 GROUP BY 1, 2)"""


def line_maps(spark, sf_dir) -> list[DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    return [li.where(c).groupBy(F.col("l_suppkey").alias("o"), F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")) for c in ("true", "l_linestatus = 'O' or l_suppkey % 3 = 0")]


@query(f"""WITH {MAP_SQL}, j AS (SELECT coalesce(a.o, b.o) AS o, a.k AS ak, b.k AS bk, a.lo, a.hi, b.lo AS blo, b.hi AS bhi FROM a FULL JOIN b ON a.o = b.o AND a.k = b.k)
 SELECT o, bool_and(CASE WHEN bk IS NULL THEN true WHEN ak IS NULL THEN false ELSE lo <= blo AND hi >= bhi END) AS weaker, bool_and(CASE WHEN ak IS NULL THEN true WHEN bk IS NULL THEN false ELSE blo <= lo AND bhi >= hi END) AS back,
 bool_and(ak IS NOT NULL AND bk IS NOT NULL AND lo = blo AND hi = bhi) AS equal FROM j GROUP BY 1""")
def map_order(spark, sf_dir):
    """Suppliers' maps over all lines against those over some of them."""
    a, b = line_maps(spark, sf_dir)
    test = lambda col: ranges.weaker(col("lo"), col("hi"), col("lo_b"), col("hi_b"))
    back = maps.weaker(b, a, ["o"], ["k"], test).withColumnRenamed("weaker", "back")
    return maps.weaker(a, b, ["o"], ["k"], test).join(back, "o").join(maps.equal(a, b, ["o"], ["k"]), "o")


@query("SELECT s_nationkey AS o, '{' || string_agg(s_suppkey || ': ' || coalesce(CAST(CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS VARCHAR), 'nil_Top'), ', ' ORDER BY s_suppkey) || '}' AS text FROM supplier GROUP BY 1")
def map_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("o"), F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal")).alias("v"))
    return maps.text(s, ["o"], "k", F.col("v"))


@query("""WITH l AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 0 AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT o_custkey, min(o_totalprice), 1 FROM orders GROUP BY 1),
 f AS (SELECT k, arg_min(v, d) AS v FROM l GROUP BY k) SELECT c_custkey AS k, v, coalesce(v, -1) AS with_default, v IS NOT NULL AS found, c_custkey IN (SELECT k FROM l) AS present FROM customer LEFT JOIN f ON k = c_custkey""")
def map_get(spark, sf_dir):
    """Customers' values through two layers, with and without a default, and whether any layer has them."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    layers = [o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")), o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v"))]
    flat = maps.flatten(layers, ["k"])
    d = maps.with_default(flat.withColumnRenamed("v", "with_default"), c, ["k"], {"with_default": -1.0})
    keys = maps.all_keys(layers, ["k"]).withColumn("_in", F.lit(True))
    return maps.get(layers, ["k"], c).join(d, "k").join(keys, "k", "left").select("k", "v", "with_default", F.col("v").isNotNull().alias("found"), F.coalesce("_in", F.lit(False)).alias("present"))


@query("""SELECT c_custkey AS k, c_acctbal AS local, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CAST(n_regionkey AS DOUBLE)) AS chained FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def map_scope(spark, sf_dir):
    """Local values over a parent's, in the scope of customers with orders."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("local"), maps.chained(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.col("n_regionkey").cast("double")).alias("chained"))
    return maps.scoped(m, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT p_partkey, CAST(7 AS INT) AS put, p_size AS kept, p_size + 1 AS met, CAST(NULL AS INT) AS removed, CAST(3 AS INT) AS n FROM part")
def map_stores(spark, sf_dir):
    """Sorted stores in one row: put, get, remove and meet."""
    s = F.create_map(F.lit(1), F.col("p_size"), F.lit(2), F.lit(5))
    put = maps.store_put(s, F.lit(2), F.lit(7))
    both = maps.store_meet(put, F.create_map(F.lit(1), F.lit(1), F.lit(3), F.lit(9)), lambda x, y: x + y)
    return table(spark, sf_dir, "part").select("p_partkey", maps.store_get(put, F.lit(2)).alias("put"), maps.store_get(put, F.lit(1)).alias("kept"), maps.store_get(both, F.lit(1)).alias("met"),
                                               maps.store_get(maps.store_remove(put, F.lit(2)), F.lit(2)).alias("removed"), F.size(both).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, a OR b AS met, a AND b AS joined, a OR b AS widened, a OR NOT b AS weaker, (a OR c) AS pair_in, (b OR a) AS pair_out FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 25 AS a, l_discount > 0.05 AS b, l_returnflag = 'R' AS c FROM lineitem) x""")
def two_points(spark, sf_dir):
    """The two-point lattice on columns, and pairs of it; null is top."""
    a, b, c = (F.expr(f"case when {x} then true end") for x in ("l_quantity > 25", "l_discount > 0.05", "l_returnflag = 'R'"))
    both = maps.pair(maps.point_meet, a, b, c, a)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", maps.point_meet(a, b).alias("met"), maps.point_join(a, b).alias("joined"), maps.point_widen(a, b).alias("widened"), maps.point_weaker(a, b).alias("weaker"),
                                                   both["in"].alias("pair_in"), both["out"].alias("pair_out"))


@query(f"""WITH {CHUNK_SQL} SELECT fid, chunk, node + 1 AS node, k AS v FROM ch WHERE (fid, chunk, node + 1) IN (SELECT (fid, chunk, node) FROM ch)""")
def pair_updates(spark, sf_dir):
    """The IN of every node is the OUT of the one before."""
    c = chunks(spark, sf_dir)
    return maps.pair_update(c.select("fid", "chunk", "node", F.lit("OUT").alias("point"), F.col("k").alias("v")), in_a_row(c), ["fid", "chunk"], ["v"], [F.max("v").alias("v")])


@query("""SELECT p_partkey, '{' || array_to_string(list_sort(list_distinct([CAST(p_size AS BIGINT), p_partkey, 7])), ', ') || '}' AS added, '{' || array_to_string(list_sort(list_distinct(list_filter([CAST(p_size AS BIGINT), p_partkey], lambda x: x <> 7))), ', ') || '}' AS removed,
 p_size = 7 OR p_partkey = 7 AS has7, CAST(CASE WHEN p_size = p_partkey THEN 1 ELSE 2 END AS INT) AS n, false AS is_empty, p_size < p_partkey AS normal FROM part""")
def set_edits(spark, sf_dir):
    s = sets.make(F.array(F.col("p_size").cast("bigint"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", sets.text(sets.add(s, F.lit(7).cast("bigint"))).alias("added"), sets.text(sets.remove(s, F.lit(7).cast("bigint"))).alias("removed"), sets.contains(s, F.lit(7).cast("bigint")).alias("has7"),
                                               sets.length(s).alias("n"), sets.is_empty(s).alias("is_empty"), sets.is_normal(F.array(F.col("p_size").cast("bigint"), "p_partkey")).alias("normal"))


# scalars

KIND_SQL = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 24 AS k, l_suppkey % 32 AS s, l_orderkey % 1000 AS n FROM lineitem), w AS (SELECT *, NOT (k BETWEEN 19 AND 23 OR k = 14) AS hs FROM q),
 e AS (SELECT *, (k << 25) | (CASE WHEN hs THEN s ELSE 0 END << 20) AS p FROM w), i AS (SELECT *, p | n AS id FROM e)"""


def packed_ids(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("l_partkey % 24").alias("k"), F.expr("l_suppkey % 32").alias("s"), F.expr("l_orderkey % 1000").alias("n"))
    return d.withColumn("id", S.pack_id(F.col("k"), F.col("s"), F.col("n")))


@query(f"""WITH {KIND_SQL} SELECT l_orderkey, l_linenumber, l_partkey, id | (CAST(2 AS BIGINT) << 30) AS marked, id AS plain, CAST(2 AS BIGINT) AS top, k <> 0 AND (NOT hs OR s <> 0) AS prefixed, k <> 0 AND (NOT hs OR s <> 0) AND n <> 0 AS proper,
 (CAST(7 AS BIGINT) << 25) | (CASE WHEN hs THEN s ELSE 0 END << 20) AS grp, k = 7 AND s <> 0 AND n = 0 AS is_grp, CAST(CASE WHEN hs THEN 5 ELSE 0 END AS INT) AS sub_bits, CAST(CASE WHEN hs THEN 20 ELSE 25 END AS INT) AS seq_bits,
 CASE WHEN hs THEN (k << 5) | s ELSE k END AS prefix16, '(eid:0x0-' || lower(to_hex(k)) || '-' || lower(to_hex(CASE WHEN hs THEN s ELSE 0 END)) || '-' || lower(to_hex(n)) || ')' AS text FROM i""")
def id_fields(spark, sf_dir):
    d, e = packed_ids(spark, sf_dir), F.col("id")
    marked = S.with_top_bits(e, F.lit(2))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", marked.alias("marked"), S.true_id(marked).alias("plain"), S.top_bits(marked).cast("bigint").alias("top"), S.has_proper_prefix(e).alias("prefixed"), S.is_proper(e).alias("proper"),
                    S.var_group(e).alias("grp"), S.is_var_group(e).alias("is_grp"), S.sub_kind_bits(S.kind(e)).alias("sub_bits"), S.seq_bits(S.kind(e)).alias("seq_bits"), S.kind_prefix16(F.col("k"), F.col("s")).alias("prefix16"), S.id_text(e).alias("text"))


@query("""SELECT p_partkey, k BETWEEN 1 AND 7 AS var, k BETWEEN 8 AND 10 AS lit, k = 12 AS fun, k = 14 AS lab, k = 11 AS typ, i BETWEEN 6 AND 11 AS asg, i IN (10, 12) AS has_call, i = 14 AS cond, i IN (13, 14) AS jump, i IN (13, 15) AS skipped, i = 16 AS ret,
 i = 11 AS phi, i = 12 AS is_call, i = 13 AS is_goto, i = 15 AS is_label, CAST(CASE WHEN j > 16 THEN 1 WHEN j IN (3, 11) THEN 0 ELSE j END AS INT) AS checked FROM (SELECT p_partkey, p_size % 24 AS k, p_size % 17 AS i, p_size % 20 AS j FROM part) x""")
def kind_tests(spark, sf_dir):
    """What entity and instruction kinds are; kinds that cannot be loaded are left out."""
    k, i, j = (F.expr(f"p_size % {n}") for n in (24, 17, 20))
    tests = {"var": S.is_variable(k), "lit": S.is_literal(k), "fun": S.is_function(k), "lab": S.is_label(k), "typ": S.is_data_type(k), "asg": S.is_assign(i), "has_call": S.has_call(i), "cond": S.is_cond(i), "jump": S.is_local_jump(i),
             "skipped": S.skipped(i), "ret": S.is_return(i), "phi": S.is_phi(i), "is_call": S.is_call(i), "is_goto": S.is_goto(i), "is_label": S.is_label_insn(i)}
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in tests.items()], F.when(j.isin(3, 11), 0).otherwise(S.checked_kind(F.when(~j.isin(3, 11), j))).cast("int").alias("checked"))


@query("""SELECT p_partkey, x = 21 AS is_call, x = 1 OR x BETWEEN 23 AND 30 AS single, NOT (x = 1 OR x BETWEEN 23 AND 30 OR x = 21) AS two, x BETWEEN 13 AND 16 AS rel, x IN (2, 4, 7, 8, 9) AS comm, x IN (17, 18) AS arr, x = 26 OR (x BETWEEN 17 AND 21 AND v BETWEEN 17 AND 24) AS deref,
 x IN (18, 20, 27) OR (x = 1 AND e = 12) AS addr, CAST(CASE WHEN x = 26 THEN 1 ELSE x END AS INT) AS put_kind, CASE WHEN x = 26 OR x BETWEEN 17 AND 21 THEN -1 ELSE p_partkey END AS put_op FROM (SELECT p_partkey, p_size % 32 AS x, p_partkey % 32 AS v, p_partkey % 24 AS e FROM part) y""")
def expression_tests(spark, sf_dir):
    x, v, e = F.expr("p_size % 32"), F.expr("p_partkey % 32"), F.expr("p_partkey % 24")
    put = S.replace_pointee(F.struct(x.alias("xkind"), F.col("p_partkey").alias("op1")), F.lit(-1).cast("bigint"))
    return table(spark, sf_dir, "part").select("p_partkey", S.is_call_expr(x).alias("is_call"), S.is_single_operand(x).alias("single"), S.is_two_operand(x).alias("two"), S.is_relational(x).alias("rel"), S.is_commutative(x).alias("comm"), S.has_array_index(x).alias("arr"),
                                               S.has_deref(x, v, F.lit(0)).alias("deref"), S.has_addrof(x, e).alias("addr"), put["xkind"].cast("int").alias("put_kind"), put["op1"].alias("put_op"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN i BETWEEN 6 AND 11 THEN l_partkey ELSE -1 END AS lhs, CASE WHEN i BETWEEN 6 AND 11 THEN CASE WHEN two THEN l_suppkey ELSE l_partkey END WHEN i IN (12, 14, 16) THEN l_partkey ELSE -1 END AS rhs,
 CASE WHEN i = 14 THEN CASE WHEN two THEN l_suppkey ELSE -1 END WHEN i IN (13, 15) THEN l_partkey ELSE -1 END AS yes, CASE WHEN i = 14 THEN CASE WHEN two THEN 5 ELSE -1 END WHEN i IN (13, 15) THEN l_partkey ELSE -1 END AS no, CASE WHEN two AND m = 0 THEN l_suppkey WHEN m = 1 THEN l_partkey ELSE -1 END AS callee,
 CAST(CASE WHEN two THEN 4 ELSE 2 END AS INT) AS n_operands FROM (SELECT *, l_orderkey % 17 AS i, l_linenumber % 2 = 0 AS two, l_partkey % 3 AS m FROM lineitem) x""")
def instruction_parts(spark, sf_dir):
    """Sides, labels, call expressions and operands of instructions."""
    i, two, m = F.expr("l_orderkey % 17"), F.expr("l_linenumber % 2 = 0"), F.expr("l_partkey % 3")
    expr = lambda k, a, b, *args: F.struct(k.cast("int").alias("xkind"), a.alias("op1"), b.alias("op2"), F.array(*args).cast("array<bigint>").alias("args"))
    none = F.lit(None).cast("bigint")
    e1 = expr(F.when(m == 1, int(X.CALL)).otherwise(1), F.col("l_partkey"), none, F.lit(9))
    e2 = F.when(two, expr(F.when(m == 0, int(X.CALL)).otherwise(1), F.col("l_suppkey"), F.lit(5).cast("bigint")))
    labels, call = S.branch_labels(i, e1, e2), S.call_expression(e1, e2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.lhs(i, e1)["op1"].alias("lhs"), S.rhs(i, e1, e2)["op1"].alias("rhs"), labels["true"].alias("yes"), labels["false"].alias("no"), call["op1"].alias("callee"),
                                                   F.size(S.operands(e1, e2)).alias("n_operands")).fillna(-1)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l AND r THEN 7 WHEN l THEN 8 ELSE 9 END AS INT) AS kind, CAST(CASE WHEN l_linenumber = 1 THEN 10 WHEN l AND r THEN 7 WHEN l THEN 8 ELSE 9 END AS INT) AS with_calls, (l_partkey >> 3) & 1 = 1 AS bit3, l_partkey | 32 AS with5, l_partkey & ~CAST(32 AS BIGINT) AS without5
 FROM (SELECT *, l_suppkey % 2 = 0 AS l, l_partkey % 2 = 0 AS r FROM lineitem) x""")
def assign_kinds(spark, sf_dir):
    """The kind of an assignment from its sides; single bits of numbers."""
    left, right, p = F.expr("l_suppkey % 2 = 0"), F.expr("l_partkey % 2 = 0"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.assign_kind(left, right, F.lit(False)).alias("kind"), S.assign_kind(left, right, F.col("l_linenumber") == 1).alias("with_calls"),
                                                   S.is_bit_set(p, 3).alias("bit3"), S.set_bit(p, 5).alias("with5"), S.clear_bit(p, 5).alias("without5"))


WRAP = "CAST((({v}) % 18446744073709551616 + 27670116110564327424) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"


@query("SELECT o_orderkey, " + ", ".join(f"{WRAP.format(v=f'CAST(a AS HUGEINT) {op} b')} AS x_{n}" for op, n in (("+", "add"), ("-", "sub"), ("*", "mul"))) +
       " FROM (SELECT o_orderkey, o_orderkey % 700 * 300000000000001 + 9000000000000000000 AS a, o_custkey * 1000003 + 500000000000000000 AS b FROM orders) x")
def wrapping_arithmetic(spark, sf_dir):
    """Sums, differences and products that leave 64 bits."""
    a, b = F.col("o_orderkey") % 700 * 300000000000001 + 9000000000000000000, F.col("o_custkey") * 1000003 + 500000000000000000
    ev = lambda k: S.evaluate(F.lit(int(k)), a, b)
    return table(spark, sf_dir, "orders").select("o_orderkey", ev(X.ADD).alias("x_add"), ev(X.SUB).alias("x_sub"), ev(X.MUL).alias("x_mul"))


@query("""SELECT p_partkey, CASE WHEN m = 0 THEN p_partkey WHEN m = 1 THEN -p_partkey - 1 WHEN m = 2 THEN -p_partkey ELSE CASE WHEN p_partkey = 0 THEN 1 ELSE 0 END END AS v, CASE WHEN k BETWEEN 1 AND 12 AND p_partkey * 600 BETWEEN 0 AND 1048575 THEN p_partkey * 600 ELSE -1 END AS imm
 FROM (SELECT p_partkey, p_partkey % 4 AS m, p_size % 32 AS k FROM part) x""")
def unary_values(spark, sf_dir):
    m = F.expr("p_partkey % 4")
    x = F.when(m == 0, int(X.VAL)).when(m == 1, int(X.BIT_NOT)).when(m == 2, int(X.NEGATE)).otherwise(int(X.NOT))
    return table(spark, sf_dir, "part").select("p_partkey", S.evaluate_unary(x, F.col("p_partkey")).alias("v"), F.coalesce(S.immediate20(F.col("p_partkey") * 600, F.expr("p_size % 32")), F.lit(-1)).alias("imm"))


FULL_SQL = "CASE k " + " ".join(f"WHEN {int(k)} THEN CAST({{{i}}} AS HUGEINT)" for i, k in enumerate(__import__("meetflow.functions.kinds", fromlist=["FULL_RANGE"]).FULL_RANGE)) + " END"
_RANGES = list(__import__("meetflow.functions.kinds", fromlist=["FULL_RANGE"]).FULL_RANGE.values())


@query(f"""WITH k AS (SELECT p_partkey, p_size % 10 AS k, CAST(p_partkey * 100 - 20000 AS HUGEINT) AS v FROM part WHERE p_size % 10 BETWEEN 1 AND 9), f AS (SELECT *, {FULL_SQL.format(*[a for a, _ in _RANGES])} AS lo, {FULL_SQL.format(*[b for _, b in _RANGES])} AS hi,
 CASE WHEN v < 0 THEN v + 18446744073709551616 ELSE v END AS bits FROM k) SELECT p_partkey, CAST(bits AS VARCHAR) AS bits, CAST(((bits - lo) % (hi - lo + 1) + (hi - lo + 1)) % (hi - lo + 1) + lo AS VARCHAR) AS value, CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi FROM f""")
def encoded_values(spark, sf_dir):
    """Values as 64 bits and back, cut to their kind, and each kind's full range."""
    k, v = F.expr("p_size % 10"), F.expr("p_partkey * 100 - 20000")
    bits = S.encode(v, k)
    cols = {"bits": bits, "value": S.decode(bits, k), "lo": S.full_low(k).cast("decimal(20,0)"), "hi": S.full_high(k).cast("decimal(20,0)")}
    return table(spark, sf_dir, "part").where("p_size % 10 between 1 and 9").select("p_partkey", *[c.cast("string").alias(n) for n, c in cols.items()])


@query("SELECT p_partkey, CASE p_size % 14 " + " ".join(f"WHEN {int(c)} THEN '{c.name}'" for c in ChangeCode) + " ELSE 'UnknownFactChange' END AS text, p_size % 14 BETWEEN 7 AND 10 AS has_nop, (CAST(p_partkey % 16 AS BIGINT) << 16) | (17 + p_size % 12) AS pool, "
       "(CAST(p_size AS BIGINT) << 32) | p_partkey AS instance, CAST(p_size AS BIGINT) AS analysis, p_partkey AS func FROM part")
def codes_and_pools(spark, sf_dir):
    """Change codes, pool ids, instances of analyses."""
    c, one = F.expr("p_size % 14"), S.instance_id(F.col("p_size"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", S.change_text(c).alias("text"), S.has_nop(c).alias("has_nop"), S.pool_id(F.expr("p_partkey % 16"), F.expr("17 + p_size % 12")).alias("pool"),
                                               one.alias("instance"), S.instance_analysis(one).alias("analysis"), S.instance_function(one).alias("func"))


# ids and files

@query("""WITH f AS (SELECT DISTINCT p_brand, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size <= 25), n AS (SELECT p_brand, v, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS i FROM f), c AS (SELECT p_brand, count(*) AS c FROM f GROUP BY 1),
 r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT r.p_brand, p_partkey, coalesce(v, 50 + r.i - coalesce(c, 0)) AS id FROM r LEFT JOIN n ON n.p_brand = r.p_brand AND n.i = r.i LEFT JOIN c ON c.p_brand = r.p_brand""")
def id_reuse(spark, sf_dir):
    """Freed ids (sizes up to 25) are given out again, smallest first, before new ones from 51 on."""
    p = table(spark, sf_dir, "part")
    free = ids.free_ranges(p.where("p_size <= 25").select("p_brand", F.col("p_size").cast("bigint").alias("v")), ["p_brand"], "v")
    return ids.allocate(p.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 40, start=51, free=free, strict=True)


@query("""WITH u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) SELECT row_number() OVER (ORDER BY url) AS file_id, url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, list_last(string_split(url, '/')) AS name FROM u""")
def file_registry(spark, sf_dir):
    return ids.register_files(table(spark, sf_dir, "pages"), "url")


# units

def nation_units(spark, sf_dir) -> dict[str, DataFrame]:
    """A unit for each region: nations are its functions, each with an assignment and a return; names, a type and literals."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rid, fid = F.col("n_regionkey").cast("bigint").alias("tu_id"), (F.col("n_nationkey") + 100).cast("bigint")
    null = lambda t: F.lit(None).cast(t)
    expr = lambda a, b=None: F.struct(F.lit(1 if b is None else 2).alias("xkind"), a.cast("bigint").alias("op1"), (null("bigint") if b is None else b.cast("bigint")).alias("op2"), F.array().cast("array<bigint>").alias("args"))
    ent = {"anonymous": null("boolean"), "member_access": null("boolean"), "qtype": null("int"), "parent_eid": fid, "data_type_eid": null("bigint"), "high_val": null("decimal(20,0)"), "line": null("int"), "col": null("int")}
    var = n.select(rid, (F.col("n_nationkey") + 1000).cast("bigint").alias("eid"), F.lit(2).alias("ekind"), F.lit(4).alias("vkind"), null("decimal(20,0)").alias("low_val"), null("string").alias("str_val"), *[v.alias(k) for k, v in ent.items()])
    lit = n.select(rid, (F.col("n_nationkey") + 2000).cast("bigint").alias("eid"), F.lit(8).alias("ekind"), F.lit(4).alias("vkind"), F.col("n_nationkey").cast("decimal(20,0)").alias("low_val"), F.col("n_name").alias("str_val"), *[v.alias(k) for k, v in ent.items()])
    insn = n.select(rid, fid.alias("fid"), F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(8).alias("ikind"), expr(F.col("n_nationkey") + 1000).alias("expr1"), expr(F.col("n_nationkey") + 2000, F.col("n_nationkey") + 1000).alias("expr2")),
        F.struct(F.lit(1).alias("seq"), F.lit(16).alias("ikind"), expr(F.col("n_nationkey") + 1000).alias("expr1"), F.lit(None).alias("expr2")))).alias("_i"))
    types_ = r.select(F.col("r_regionkey").cast("bigint").alias("tu_id"), F.lit(50).cast("bigint").alias("type_id"), F.lit(17).alias("vkind"), null("string").alias("attributes"), null("int").alias("len"), null("int").alias("align"), null("bigint").alias("sub_type_eid"),
                      F.col("r_name").alias("type_name"), null("boolean").alias("anonymous"), null("boolean").alias("func_prototype"), null("boolean").alias("variadic"), F.array(F.lit(1)).cast("array<bigint>").alias("fop_ids"), F.array(F.lit(0)).cast("array<bigint>").alias("fop_type_eids"),
                      null("int").alias("line"), null("int").alias("col"))
    return {"tu": r.select(F.col("r_regionkey").cast("bigint").alias("tu_id"), F.col("r_name").alias("name"), null("string").alias("abs_path"), F.lit("tables").alias("origin")),
            "name_id": n.select(rid, F.concat(F.lit("v:f:"), "n_name").alias("name"), (F.col("n_nationkey") + 1000).cast("bigint").alias("eid")), "entity": var.unionByName(lit), "data_type": types_,
            "func": n.select(rid, fid.alias("fid"), F.concat(F.lit("f:"), "n_name").alias("fname"), F.lit(False).alias("is_variadic"), F.lit(0).cast("bigint").alias("type_eid"), null("string").alias("calling_convention")),
            "insn": insn.select("tu_id", "fid", "_i.*", null("int").alias("line"), null("int").alias("col"))}


def read_back(spark, sf_dir) -> dict[str, DataFrame]:
    """The units written in the wire format, a file each, and read again."""
    from uuid import uuid4

    from .plans.rounds import shared_dir

    folder = f"{shared_dir(spark)}/units-{uuid4().hex}"
    wire.save_units(nation_units(spark, sf_dir), folder)
    return wire.read_units(spark, folder)


@query("""SELECT r_name AS unit, 'f:' || n_name AS fname, CAST(seq AS INT) AS seq, CAST(CASE seq WHEN 0 THEN 8 ELSE 16 END AS INT) AS ikind, CAST(n_nationkey + 1000 AS BIGINT) AS a, CASE seq WHEN 0 THEN CAST(n_nationkey + 2000 AS BIGINT) ELSE -1 END AS b, CASE seq WHEN 0 THEN CAST(n_nationkey + 1000 AS BIGINT) ELSE -1 END AS c
 FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT unnest([0, 1]) AS seq) x""")
def wire_instructions(spark, sf_dir):
    t = read_back(spark, sf_dir)
    j = t["insn"].join(t["func"], ["tu_id", "fid"]).join(t["tu"].select("tu_id", F.col("name").alias("unit")), "tu_id")
    return j.select("unit", "fname", "seq", "ikind", F.col("expr1.op1").alias("a"), F.col("expr2.op1").alias("b"), F.col("expr2.op2").alias("c")).fillna(-1)


@query("""SELECT r_name AS unit, CAST(n_nationkey + x.o AS BIGINT) AS eid, CAST(CASE x.o WHEN 1000 THEN 2 ELSE 8 END AS INT) AS ekind, CASE x.o WHEN 1000 THEN 'v:f:' || n_name ELSE CASE WHEN n_nationkey >= 0 THEN n_name END END AS name, CASE x.o WHEN 2000 THEN CAST(n_nationkey AS VARCHAR) END AS low, r_name AS type_name
 FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT unnest([1000, 2000]) AS o) x""")
def wire_entities(spark, sf_dir):
    t = read_back(spark, sf_dir)
    n = text.names(t["entity"], t["name_id"], t["data_type"])
    j = t["entity"].join(n, ["tu_id", "eid"]).join(t["tu"].select("tu_id", F.col("name").alias("unit")), "tu_id").join(t["data_type"].select("tu_id", "type_name"), "tu_id")
    return j.select("unit", "eid", "ekind", "name", F.col("low_val").cast("string").alias("low"), "type_name")


@query("""SELECT r_name AS unit, part, text FROM region JOIN (SELECT n_regionkey AS rk, '6 function' AS part, 'int32 ' || n_name || '()' AS text FROM nation UNION ALL SELECT n_regionkey, '5 variable', 'v:f:' || n_name FROM nation UNION ALL SELECT n_regionkey, '3 literal', n_name FROM nation
 UNION ALL SELECT n_regionkey, '7 body', n_name || ' = ' || n_name || ' + ' || n_name FROM nation UNION ALL SELECT n_regionkey, '7 body', 'return ' || n_name FROM nation UNION ALL SELECT n_regionkey, '1 id', 'v:f:' || n_name FROM nation UNION ALL SELECT r_regionkey, '2 type', 'int32*' FROM region
 UNION ALL SELECT r_regionkey, '0 unit', r_name || ' tables' FROM region) x ON rk = r_regionkey""")
def dump_units(spark, sf_dir):
    t = read_back(spark, sf_dir)
    return text.dump(t).join(t["tu"].select("tu_id", F.col("name").alias("unit")), "tu_id").select("unit", "part", "text")


@query(f"""WITH {PROG_SQL}, n AS (SELECT n_nationkey AS i, n_name AS s FROM nation), o AS (SELECT ins.*, a.s AS a, b.s AS b, c.s AS c, k % 10 AS m FROM ins JOIN n a ON a.i = k % 25 JOIN n b ON b.i = (k + 7) % 25 JOIN n c ON c.i = (k + 11) % 25)
 SELECT fid, seq, CAST(CASE t WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 15 ELSE 13 END WHEN 'click' THEN 14 WHEN 'signup' THEN CASE m WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 10 ELSE 6 END WHEN 'purchase' THEN CASE WHEN m < 5 THEN 12 ELSE 16 END
 ELSE CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END END AS INT) AS ikind,
 CASE t WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN a || ':' ELSE 'goto ' || a END WHEN 'click' THEN 'if ' || a WHEN 'signup' THEN CASE m WHEN 0 THEN a || ' = ' || b WHEN 1 THEN a || ' = ' || b || ' + ' || c WHEN 2 THEN '*' || a || ' = ' || b WHEN 3 THEN a || ' = ' || b || '(' || c || ', ' || a || ')' ELSE a END
 WHEN 'purchase' THEN CASE WHEN m < 5 THEN a || '(' || b || ')' ELSE 'return ' || a END ELSE CASE m WHEN 0 THEN 'nop' WHEN 1 THEN 'barrier' WHEN 2 THEN 'use_kill' ELSE 'use' END END AS text FROM o""")
def constructed_insns(spark, sf_dir):
    """Events as instructions of every constructor over names of nations, as text."""
    R, k, m = build.Rows, F.col("k"), F.col("k") % 10
    a, b, c = k % 25, (k + 7) % 25, (k + 11) % 25
    signup = (F.when(m == 0, R.assign(R.value(a), R.value(b))).when(m == 1, R.assign(R.value(a), R.expr(X.ADD, b, c))).when(m == 2, R.assign(R.expr(X.DEREF, a), R.value(b)))
              .when(m == 3, R.assign(R.value(a), R.expr(X.CALL, b, None, c, a))).otherwise(R.self_assign(a)))
    other = F.when(m == 0, R.one(I.NOP)).when(m == 1, R.one(I.BARRIER)).when(m == 2, R.use(a, b, c, kill=True)).otherwise(R.use(a, b))
    made = (F.when(F.col("t") == "view", F.when(k % 2 == 0, R.one(I.LABEL, a)).otherwise(R.one(I.GOTO, a))).when(F.col("t") == "click", R.cond(a, b, c)).when(F.col("t") == "signup", signup)
            .when(F.col("t") == "purchase", F.when(m < 5, R.call(a, b)).otherwise(R.one(I.RETURN, a))).otherwise(other))
    one = F.lit(1).cast("bigint").alias("tu_id")
    insn = program(spark, sf_dir).select(one, "fid", "seq", made.alias("i")).select("tu_id", "fid", "seq", "i.*")
    names = table(spark, sf_dir, "nation").select(one, F.col("n_nationkey").cast("bigint").alias("eid"), F.col("n_name").alias("text"))
    return text.insn_text(insn, names).select("fid", "seq", "ikind", "text")


@query("SELECT user_id AS fn, max(CAST(value AS INT)) AS version, count(*) FILTER (WHERE CAST(value AS INT) = m) AS n FROM (SELECT *, max(CAST(value AS INT)) OVER (PARTITION BY user_id) AS m FROM events) x GROUP BY 1")
def stream_latest(spark, sf_dir):
    """Events as versions of functions, streamed: facts of each function's newest version."""
    from uuid import uuid4

    from .plans.rounds import shared_dir
    from .streaming.incremental import analyse_stream, current

    top = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    # rint takes halves to the even integer, as the cast in SQL does
    rows = rows.select(F.col("user_id").alias("fn"), F.rint("value").cast("int").alias("version"), "event_id")
    analyse_stream(rows, ["fn"], "version", lambda d: d.groupBy("fn").agg(F.count(F.lit(1)).alias("n")), f"{top}/facts", f"{top}/checkpoint").awaitTermination()
    return current(spark.read.parquet(f"{top}/facts"), ["fn"], "version", spark.read.parquet(f"{top}/facts-versions")).select("fn", "version", "n")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f, l_partkey AS e FROM lineitem), a AS (SELECT s, e FROM s WHERE f = 'A'), n AS (SELECT s, e FROM s WHERE f = 'N'), r AS (SELECT s, e FROM s WHERE f = 'R'),
 o AS (SELECT 'all' AS op, s, e FROM (SELECT DISTINCT s, e FROM s) z UNION ALL SELECT 'returned twice', * FROM (SELECT * FROM a INTERSECT SELECT * FROM r) z
 UNION ALL SELECT 'only returned', * FROM ((SELECT * FROM a UNION SELECT * FROM r) EXCEPT SELECT * FROM n) z)
 SELECT op, CAST(s AS BIGINT) AS supplier, count(*)::BIGINT AS n, sum(e)::BIGINT AS total, bool_or(op = 'only returned') AS beyond FROM o GROUP BY op, s""")
def word_sets(spark, sf_dir):
    """Parts of each supplier by return flag as sets of words: all flags met, A and R, A or R without N."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("supplier"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    words, key = Tables(spark).keep(bitsets.pack(rows, ["supplier", "flag"], "part")), ["supplier"]
    a, n, r = (words.where(F.col("flag") == f) for f in "ANR")
    returned = bitsets.union(a, r, key)
    found = {"all": bitsets.meet_all(words, key), "returned twice": bitsets.intersection(a, r, key), "only returned": bitsets.difference(returned, n, key)}
    out = None
    for name, w in found.items():
        sums = bitsets.unpack(w, key, "e").groupBy(*key).agg(F.sum("e").alias("total"))
        part = bitsets.lengths(w, key).join(sums, key).select(F.lit(name).alias("op"), "supplier", "n", "total")
        beyond = bitsets.not_within(w, bitsets.meet_all(words, key) if name != "only returned" else n, key).withColumn("beyond", F.lit(True))
        part = part.join(beyond, key, "left").withColumn("beyond", F.coalesce("beyond", F.lit(False)))
        out = part if out is None else out.unionByName(part)
    return out
