"""Registered queries of analyses that work together, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.kinds import EdgeLabel
from .functions.kinds import ExprKind as X
from .plans import cooperation
from .plans.framework import Analysis, Solver
from .program_queries import CHUNK_SQL, chunks
from .registry import query

#: Variables of a function: two numbers, what is loaded, the pointer.
A, B, LOADED, POINTER = 0, 1, 2, 3

_NUM, _AIM = ("al", "ah", "bl", "bh", "xl", "xh"), ("pa", "pb")


def _least(col: str, *cases: str) -> str:
    return f"{'least' if col.endswith('l') else 'greatest'}({', '.join(cases)})"


def _next_state() -> str:
    """State before the next node, and what a skip brings to the node after it."""
    one = {c: f"n{c}" for c in _NUM} | {"xl": "CASE WHEN t = 'click' AND nxl = 0 THEN 1 ELSE nxl END", "xh": "CASE WHEN t = 'click' AND nxh = 0 THEN -1 ELSE nxh END"}
    two = {c: f"n{c}" for c in _NUM} | {"xl": "0", "xh": "0"}
    now = [_least(c, f"CASE WHEN go1 THEN {one[c]} END", f"CASE WHEN go0 AND lastone THEN {two[c]} END", f"{c}2") + f" AS {c}" for c in _NUM]
    now += [f"(go1 AND n{c}) OR (go0 AND lastone AND n{c}) OR {c}2 AS {c}" for c in _AIM]
    later = [f"CASE WHEN go0 AND NOT lastone THEN {two[c]} END AS {c}2" for c in _NUM] + [f"go0 AND NOT lastone AND n{c} AS {c}2" for c in _AIM]
    return ", ".join(["go1 OR (go0 AND lastone) OR r2 AS r", *now, "go0 AND NOT lastone AS r2", *later])


_STORE = {c: f"CASE WHEN t = 'purchase' AND p{c[0]} THEN CASE WHEN p{'b' if c[0] == 'a' else 'a'} THEN {_least(c, c, 'k % 4')} ELSE k % 4 END" for c in _NUM[:4]}
_NEW = {
    "al": _STORE["al"] + " WHEN t = 'error' THEN CASE WHEN k < 50 THEN xl + 1 ELSE al - xh END ELSE al END",
    "ah": _STORE["ah"] + " WHEN t = 'error' THEN CASE WHEN k < 50 THEN xh + 1 ELSE ah - xl END ELSE ah END",
    "bl": _STORE["bl"] + " ELSE bl END", "bh": _STORE["bh"] + " ELSE bh END",
    "xl": "CASE WHEN t = 'view' THEN least(CASE WHEN pa THEN al END, CASE WHEN pb THEN bl END) ELSE xl END",
    "xh": "CASE WHEN t = 'view' THEN greatest(CASE WHEN pa THEN ah END, CASE WHEN pb THEN bh END) ELSE xh END",
    "pa": "CASE WHEN t = 'signup' THEN k % 2 = 0 ELSE pa END", "pb": "CASE WHEN t = 'signup' THEN k % 2 = 1 ELSE pb END",
}
_STATE = ("r", *_NUM, *_AIM, "r2", *[f"{c}2" for c in (*_NUM, *_AIM)])
_NIL = ", ".join(["false", *["CAST(NULL AS BIGINT)"] * 6, "false", "false"])

LAST_SQL = f"""{CHUNK_SQL}, lst AS (SELECT fid, chunk, max(node) AS ln FROM ch GROUP BY 1, 2), cl AS (SELECT ch.fid, ch.chunk, CAST(ch.node AS BIGINT) AS node, t, k, node = ln AS lastone FROM ch JOIN lst ON lst.fid = ch.fid AND lst.chunk = ch.chunk)"""
#: One row a function and node: the whole state, walked from node to node.
STATE_SQL = f"""WITH RECURSIVE {LAST_SQL},
 st(fid, chunk, node, {', '.join(_STATE)}) AS (SELECT fid, chunk, CAST(0 AS BIGINT), true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), chunk % 2 = 0, false, {_NIL} FROM lst
 UNION ALL SELECT fid, chunk, node + 1, {_next_state()} FROM (
 SELECT *, ok AND (t <> 'click' OR NOT (xl = 0 AND xh = 0)) AS go1, ok AND t = 'click' AND xl <= 0 AND xh >= 0 AS go0 FROM (
 SELECT st.*, t, k, lastone, r AND NOT (t IN ('view', 'purchase') AND NOT (pa OR pb)) AS ok, {', '.join(f'{v} AS n{c}' for c, v in _NEW.items())}
 FROM st JOIN cl ON cl.fid = st.fid AND cl.chunk = st.chunk AND cl.node = st.node) s) z)"""


def pointer_functions(spark, sf_dir):
    """Eight events of a user in a row are a function.

    Signups point p at a or b, views load x = *p, purchases store *p = k % 4, errors
    set a = x + 1 or a = a - x, clicks branch on x: where it is 0 the next node is
    skipped.  a = 0, b = 1, x = 0 at entry; p points to a in every other function and
    nowhere in the rest.
    """
    c, fn = chunks(spark, sf_dir), ["fid", "chunk"]
    t, k = F.col("t"), F.col("k")
    case = lambda **of: F.coalesce(*[F.when(t == name, v if hasattr(v, "cast") else F.lit(v)) for name, v in of.items()])
    op = case(signup="addr", view="load", purchase="store", error="assign", click="branch")
    insn = c.select(*fn, "node", op.alias("op"), case(signup=POINTER, view=LOADED, purchase=POINTER, error=A).alias("x"),
                    case(signup=k % 2, view=POINTER, click=LOADED, error=F.when(k < 50, LOADED).otherwise(A)).alias("a_var"), case(purchase=k % 4).alias("a_const"),
                    case(error=F.when(k >= 50, LOADED)).alias("b_var"), case(error=F.when(k < 50, 1)).alias("b_const"), case(error=F.when(k < 50, int(X.ADD)).otherwise(int(X.SUB))).alias("xkind"))
    last = c.groupBy(*fn).agg((F.max("node") + 1).alias("_exit"))
    side = lambda label, by: F.struct((F.least(F.col("node") + by, F.col("_exit"))).alias("dst"), F.lit(int(label)).alias("label"))
    edges = c.join(last, fn).select(*fn, F.col("node").alias("src"), F.inline(F.when(t == "click", F.array(side(EdgeLabel.TRUE, 1), side(EdgeLabel.FALSE, 2))).otherwise(F.array(side(EdgeLabel.SIMPLE, 1)))))
    none = F.lit(None).cast("bigint")
    held = lambda var, v: F.struct(F.lit(var).cast("bigint").alias("var"), none.alias("target"), F.lit(v).cast("bigint").alias("lo"), F.lit(v).cast("bigint").alias("hi"))
    aim = F.when(F.col("chunk") % 2 == 0, F.struct(F.lit(POINTER).cast("bigint").alias("var"), F.lit(A).cast("bigint").alias("target"), none.alias("lo"), none.alias("hi")))
    entry = last.select(*fn, F.inline(F.array_compact(F.array(held(A, 0), held(B, 1), held(LOADED, 0), aim))))
    return insn, entry, edges, c.where("node = 0").select(*fn, "node")


@query(STATE_SQL + """ SELECT fid, chunk, node, w.domain, w.var, w.target, CASE w.i WHEN 1 THEN al WHEN 2 THEN bl WHEN 3 THEN xl ELSE 0 END AS lo, CASE w.i WHEN 1 THEN ah WHEN 2 THEN bh WHEN 3 THEN xh ELSE 0 END AS hi
 FROM st, (SELECT * FROM (VALUES (0, 'reach', -1, -1), (1, 'range', 0, -1), (2, 'range', 1, -1), (3, 'range', 2, -1), (4, 'target', 3, 0), (5, 'target', 3, 1)) v(i, domain, var, target)) w
 WHERE r AND CASE w.i WHEN 4 THEN pa WHEN 5 THEN pb ELSE true END""")
def cooperating_facts(spark, sf_dir):
    """Ranges and targets before every node, found together: targets decide what loads and stores are, ranges which sides of branches there are."""
    facts = cooperation.cooperate(*pointer_functions(spark, sf_dir), ["fid", "chunk"], full=(-(2**31), 2**31 - 1))
    return facts.select("fid", "chunk", F.col("node").cast("bigint").alias("node"), "domain", F.coalesce("var", F.lit(-1)).cast("int").alias("var"), F.coalesce("target", F.lit(-1)).cast("int").alias("target"), "lo", "hi")


class Mirror(Analysis):
    """Purchases turn v into 100 + k - v, signups add k; where ways meet the greatest counts."""

    name, values = "mirror", ("v",)

    def __init__(self, insn) -> None:
        self.insn = insn

    def boundary(self, nodes):
        return nodes.withColumn("v", F.lit(0).cast("bigint"))

    def transfer(self, facts):
        j = facts.join(self.insn, ["fid", "chunk", "node"], "left")
        v = F.when(F.col("t") == "purchase", 100 + F.col("k") - F.col("v")).when(F.col("t") == "signup", F.col("v") + F.col("k")).otherwise(F.col("v"))
        return j.select("fid", "chunk", "node", v.alias("v"))

    def meet(self):
        return [F.max("v").alias("v")]


def mirrored(spark, sf_dir, **how):
    _, _, edges, ends = pointer_functions(spark, sf_dir)
    facts = Solver(Mirror(chunks(spark, sf_dir)), edges.drop("label").distinct(), ends, ["fid", "chunk"], **how).run()
    return facts.where("point = 'IN'").select("fid", "chunk", F.col("node").cast("bigint").alias("node"), "v")


@query(f"""WITH RECURSIVE {LAST_SQL}, st(fid, chunk, node, v, v2) AS (SELECT fid, chunk, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM lst
 UNION ALL SELECT fid, chunk, node + 1, greatest(nv, v2), CASE WHEN t = 'click' AND NOT lastone THEN nv END FROM (SELECT st.*, t, lastone, CASE t WHEN 'purchase' THEN 100 + k - v WHEN 'signup' THEN v + k ELSE v END AS nv
 FROM st JOIN cl ON cl.fid = st.fid AND cl.chunk = st.chunk AND cl.node = st.node) s) SELECT fid, chunk, node, v FROM st""")
def solver_replace_joins(spark, sf_dir):
    """New values replace old ones where ways of different length meet: a greater value before a node may be a smaller one after it, and meeting would keep both."""
    return mirrored(spark, sf_dir, meet_at_blocks=False)
