"""Ranges, targets of pointers and reachability as one product whose parts simplify instructions for each other.

What pointers may point to turns loads, stores and calls through them into simple
ones; ranges close sides of branches, so that pointers set there get no targets.
Both happen in one fixed point: a round solves the nodes again that something
before them moved at, by the views their instructions have now.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import EdgeLabel
from ..functions.kinds import ExprKind as X
from ..operators import ranges
from .analyses import bounds_of, known_operands, within
from .framework import Analysis, Solver
from .rounds import Tables

REACH, RANGE, TARGET = "reach", "range", "target"

#: Views that may be on: pointers replaced by their targets, conditions by the sides that are possible.
VIEWS = ("deref", "condition")

#: Edges from a call through a pointer to the function with number f have the label CALLS + f.
CALLS = 16


class Cooperation(Analysis):
    """The product: rows (fn, node, domain, var, target, lo, hi).

    ``insn`` (fn, node, op, x, a_var, a_const, b_var, b_const, xkind), one row a node:
    ``assign`` x = a xkind b (pointers keep their targets over copies and
    arithmetic), ``addr`` x = &a, ``load`` x = *a, ``store`` *x = a, ``branch`` on a,
    ``invoke`` (*a)(); nodes without one pass all on.  Variables are numbers, and
    those of functions too.  ``entry`` (fn, var, target, lo, hi): ranges at entry,
    or targets where ``target`` is given.  ``many`` (fn, var): variables that stand
    for several locations (arrays), which no store overwrites.

    With the view ``deref`` an instruction through a pointer is one for each target,
    a store to a single location a strong update, and a pointer without targets a
    barrier.  Without it loads and stores through pointers are anything: the full
    range, for all variables whose address is taken, and calls go to every callee
    that has an edge.  With ``condition`` a side that the range excludes is closed,
    and the other narrows the range.  All views only give more as facts grow, so the
    result doesn't depend on the order of rounds (but for widening on cycles).
    """

    name, branches, reads_often = "cooperation", True, True
    keys, values = ("domain", "var", "target"), ("lo", "hi")

    def __init__(self, insn: DataFrame, entry: DataFrame, fn: Sequence[str], *, full: tuple[int, int], views: Sequence[str] = VIEWS, many: DataFrame | None = None) -> None:
        if set(views) - set(VIEWS):
            raise ValueError(f"views are {VIEWS}")
        self.fn, self.views = list(fn), set(views)
        self.many = None if many is None else many.select(*fn, F.col("var").cast("bigint").alias("var"), F.lit(True).alias("_many")).distinct()
        number = {c: F.col(c).cast("bigint") for c in ("x", "a_var", "a_const", "b_var", "b_const")}
        self.insn = insn.select(*fn, "node", "op", *[v.alias(c) for c, v in number.items()], "xkind")
        self.entry = entry.select(*fn, *[F.col(c).cast("bigint").alias(c) for c in ("var", "target", "lo", "hi")])
        self.full = [F.lit(v).cast("bigint") for v in full]
        ops = self.insn.agg(F.bool_or(F.expr("op = 'store' and a_var is not null")), F.bool_or(F.expr("op = 'invoke'"))).first()
        self.stores_pointers, self.invokes = map(bool, ops)
        self._expressions()

    def boundary(self, nodes):
        none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
        reached = nodes.select(*nodes.columns, F.lit(REACH).alias("domain"), none.alias("var"), none.alias("target"), zero.alias("lo"), zero.alias("hi"))
        aims = F.col("target").isNotNull()
        held = nodes.join(self.entry, self.fn)
        held = held.select(*nodes.columns, F.when(aims, TARGET).otherwise(RANGE).alias("domain"), "var", "target", F.when(aims, 0).otherwise(F.col("lo")).alias("lo"), F.when(aims, 0).otherwise(F.col("hi")).alias("hi"))
        return reached.unionByName(held)

    def meet(self):
        return ranges.meet_all("lo", "hi")

    def widen(self, rows):
        lo, hi = ranges.widen(F.col("old_lo"), F.col("old_hi"), F.col("lo"), F.col("hi"), *self.full)
        may = F.col("_had").isNotNull() & (F.col("domain") == RANGE)
        return rows.withColumns({"lo": F.when(may, lo).otherwise(F.col("lo")), "hi": F.when(may, hi).otherwise(F.col("hi"))})

    def _expressions(self) -> None:
        """Built once a run: on the driver they cost more than a round's small joins."""
        deref = "deref" in self.views
        op, domain, var, x, target, lo, hi = (F.col(c) for c in ("op", "domain", "var", "x", "target", "lo", "hi"))
        pointer = F.when(op.isin("load", "invoke"), F.col("a_var")).when(op == "store", x)
        self.aimed = aimed = F.coalesce((domain == TARGET) & (var == pointer), F.lit(False))
        sides = [(s, end) for s in "ab" for end in ("lo", "hi")]
        held = [F.coalesce(F.max(f"{s}_const"), F.max(F.when((domain == RANGE) & (var == F.col(f"{s}_var")), F.col(end)))).alias(f"_{s}_{end}") for s, end in sides]
        self.before = [*held, F.count_if(aimed).alias("_aims")]
        hit, single = F.coalesce("_hit", F.lit(False)), (F.col("_aims") == 1) & F.col("_many").isNull()
        self.open = ~(op.isin("load", "store", "invoke") & (F.col("_aims") == 0))
        stays = ~F.coalesce(op.isin("assign", "addr", "load") & (var == x) | (op == "store") & hit & single, F.lit(False))

        def row(when: Column, domain: str | Column, var: Column, target: Column, lo: Column, hi: Column, label: EdgeLabel | None = None) -> Column:
            parts = (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"), var.alias("var"), target.cast("bigint").alias("target"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")
            return F.when(when, F.struct(*parts, F.lit(None if label is None else int(label)).cast("int").alias("label")))

        none, zero = F.lit(None), F.lit(0)
        operands = [F.col(f"_{s}_{end}") for s, end in sides]
        made_lo, made_hi = within(known_operands(F.col("xkind"), *operands), *bounds_of(F.col("xkind"), *operands), *self.full)
        here, keeps = domain == REACH, F.col("xkind").isin(int(X.VAL), int(X.ADD), int(X.SUB))
        # only a reached node's own row asks for the bounds
        self.made = [F.when(here & (op == "assign"), made_lo).alias("_made_lo"), F.when(here & (op == "assign"), made_hi).alias("_made_hi")]
        cut = op == "branch" if "condition" in self.views else F.lit(False)
        tested = F.coalesce((domain == RANGE) & (var == F.col("a_var")), F.lit(False))
        may = F.coalesce((F.col("_a_lo") != 0) | (F.col("_a_hi") != 0), F.lit(False))
        may_not = F.coalesce((F.col("_a_lo") <= 0) & (F.col("_a_hi") >= 0), F.lit(False))
        rows = [
            row(stays & ~cut & ~((op == "invoke") & F.lit(deref)), domain, var, target, lo, hi),
            row(cut & may, domain, var, target, F.when(tested & (lo == 0), 1).otherwise(lo), F.when(tested & (hi == 0), -1).otherwise(hi), EdgeLabel.TRUE),
            row(cut & may_not, domain, var, target, F.when(tested, 0).otherwise(lo), F.when(tested, 0).otherwise(hi), EdgeLabel.FALSE),
            row(F.col("_made_lo").isNotNull(), RANGE, x, none, F.col("_made_lo"), F.col("_made_hi")),
            row((op == "assign") & keeps & (domain == TARGET) & ((var == F.col("a_var")) | (var == F.col("b_var"))), TARGET, x, target, zero, zero),
            row((op == "addr") & here, TARGET, x, F.col("a_var"), zero, zero),
        ]
        if deref:
            rows += [row((op == "load") & hit, domain, x, target, lo, hi),
                     row((op == "store") & (domain == TARGET) & (var == x) & F.col("_a_lo").isNotNull(), RANGE, target, none, F.col("_a_lo"), F.col("_a_hi"))]
        else:
            rows.append(row((op == "load") & here, RANGE, x, none, *self.full))
        self.rows = F.inline(F.array_compact(F.array(*rows)))
        self.plain = [zero.cast("bigint").alias("lo"), zero.cast("bigint").alias("hi"), F.lit(None).cast("int").alias("label")]

    def transfer(self, facts):
        at, op, domain = [*self.fn, "node"], F.col("op"), F.col("domain")
        j = facts.join(self.insn, at, "left").withColumn("op", F.coalesce("op", F.lit("")))
        aims = j.where(self.aimed).select(*at, F.col("target").alias("var"), F.lit(True).alias("_hit"))
        if self.many is not None:
            aims = aims.join(self.many, [*self.fn, "var"], "left")
        else:
            aims = aims.withColumn("_many", F.lit(None).cast("boolean"))
        k = j.join(j.groupBy(*at).agg(*self.before), at).join(aims, [*at, "var"], "left")
        if "deref" in self.views:
            out = k.where(self.open).select("*", *self.made).select(*at, self.rows)
            if self.stores_pointers:
                what = j.where((op == "store") & (domain == TARGET) & (F.col("var") == F.col("a_var"))).select(*at, "target")
                out = out.unionByName(aims.select(*at, "var").join(what, at).select(*at, F.lit(TARGET).alias("domain"), "var", "target", *self.plain))
            if self.invokes:  # along the edges of the targets
                out = out.unionByName(j.where(op == "invoke").select(*at, *self.keys, *self.values).join(aims.select(*at, (F.col("var") + CALLS).cast("int").alias("label")), at))
            return out
        out = k.select("*", *self.made).select(*at, self.rows)
        taken = self.insn.where("op = 'addr'").select(*self.fn, F.col("a_var").alias("var")).unionByName(self.entry.where("target is not null").select(*self.fn, F.col("target").alias("var"))).distinct()
        nodes = j.where((op == "store") & (domain == REACH)).select(*at)
        lost = nodes.join(taken, self.fn)
        return out.unionByName(lost.select(*at, F.lit(RANGE).alias("domain"), "var", F.lit(None).cast("bigint").alias("target"), self.full[0].alias("lo"), self.full[1].alias("hi"), F.lit(None).cast("int").alias("label")))


def cooperate(insn: DataFrame, entry: DataFrame, edges: DataFrame, ends: DataFrame, fn: Sequence[str], *, full: tuple[int, int],
              views: Sequence[str] = VIEWS, many: DataFrame | None = None, widen_after: int = 8) -> DataFrame:
    """(fn, node, domain, var, target, lo, hi): what holds before every node that is reached; see ``Cooperation``.

    ``edges`` (fn, src, dst, label) have TRUE and FALSE out of branches and CALLS + f into
    functions called through pointers; ``ends`` (fn, node): entry nodes.  ``fn`` names at least one column.
    """
    with Tables(insn.sparkSession) as t:
        analysis = Cooperation(t.keep(insn), t.keep(entry), fn, full=full, views=views, many=many)
        facts = Solver(analysis, t.keep(edges), ends, fn, widen_after=widen_after).run()
        return Tables(insn.sparkSession).keep(facts.where("point = 'IN'").drop("point"))
