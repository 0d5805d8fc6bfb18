"""Dominators, dominance frontiers and places of phi instructions.

Graphs are edges (fn, src, dst) with one entry (fn, node) a function, all
functions at once.  Unreachable nodes take no part; self-loops and edges back to
the entry are allowed; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Tables, close_rows, close_values


def depths(e: DataFrame, entry: DataFrame, fn: Sequence[str]) -> DataFrame:
    """(fn, node, depth): edges on a shortest path from the entry."""
    fn = list(fn)
    out = e.select(*fn, F.col("src").alias("node"), F.col("dst").alias("_to"))

    def step(facts: DataFrame, changed: DataFrame) -> DataFrame:
        at = facts.join(changed, [*fn, "node"], "left_semi")
        return at.join(out, [*fn, "node"]).select(*fn, F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"))

    return close_values(entry.select(*fn, "node", F.lit(0).alias("depth")), [*fn, "node"], ["depth"], [F.min("depth").alias("depth")], step)


def dominators(e: DataFrame, entry: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """(fn, node, idom) for every reachable node but entries.

    A node with one predecessor has it as its immediate dominator.  For the others,
    joins, only ancestors in a tree of shortest paths can dominate; an ancestor does
    not if some way avoids it: by a predecessor that is not below it in the tree, or
    by one that hangs on a join (through nodes with one predecessor each) which a way
    avoiding it reaches.  The second is a closure over joins and their ancestors,
    so rows follow edges into joins times the depth of the tree, not the square of
    a function.  The deepest ancestor that is never avoided is the answer.
    """
    fn = list(fn)
    node = [*fn, "node"]
    with Tables(e.sparkSession) as t:
        depth = t.keep(depths(e, entry, fn))
        root = entry.select(*node).distinct()
        edges = e.select(*fn, "src", "dst").where("src <> dst").distinct()
        edges = edges.join(depth.select(*fn, F.col("node").alias("src"), F.col("depth").alias("_sd")), [*fn, "src"])
        edges = t.keep(edges.join(root.withColumnRenamed("node", "dst"), [*fn, "dst"], "left_anti"))
        # the parent on a shortest path, and the only predecessor where there is one
        into = edges.groupBy(*fn, F.col("dst").alias("node")).agg(F.min_by("src", F.struct("_sd", "src")).alias("up"), F.count(F.lit(1)).alias("_n"))
        into = t.keep(into)
        joins = into.where("_n > 1").select(*node)
        to = t.keep(edges.join(joins.withColumnRenamed("node", "dst"), [*fn, "dst"], "left_semi").select(*fn, "src", "dst"))
        up = into.select(*fn, F.col("node").alias("above"), "up")
        seed = joins.unionByName(to.select(*fn, F.col("src").alias("node"))).distinct().withColumn("above", F.col("node"))
        above = close_rows(seed, lambda d: d.join(up, [*fn, "above"]).select(*node, F.col("up").alias("above")))

        # ancestors of joins but entries, which nothing avoids
        open_ = above.join(joins, node, "left_semi").where("node <> above")
        open_ = t.keep(open_.join(root.withColumnRenamed("node", "above"), [*fn, "above"], "left_anti").select(*fn, F.col("node").alias("dst"), "above"))
        first = to.join(open_, [*fn, "dst"]).join(above.withColumnRenamed("node", "src"), [*fn, "src", "above"], "left_anti").select(*fn, "dst", "above").distinct()
        heads = above.join(joins.withColumnRenamed("node", "above"), [*fn, "above"], "left_semi").join(depth.withColumnRenamed("node", "above"), [*fn, "above"])
        heads = heads.groupBy(*node).agg(F.max_by("above", "depth").alias("_head"))
        hop = to.join(heads.withColumnRenamed("node", "src"), [*fn, "src"]).select(*fn, F.col("_head").alias("dst"), F.col("dst").alias("_to")).where("dst <> _to").distinct()
        hop = t.keep(hop)
        avoided = close_rows(first, lambda d: d.join(hop, [*fn, "dst"]).select(*fn, F.col("_to").alias("dst"), "above").join(open_, [*fn, "dst", "above"], "left_semi"))

        held = open_.join(avoided, [*fn, "dst", "above"], "left_anti").join(depth.withColumnRenamed("node", "above"), [*fn, "above"])
        held = held.groupBy(*fn, F.col("dst").alias("node")).agg(F.max_by("above", "depth").alias("idom"))
        tops = root.withColumnRenamed("node", "_root")
        of_joins = joins.join(tops, fn) if fn else joins.join(F.broadcast(tops.limit(1)))  # one row: one entry
        of_joins = of_joins.join(held, node, "left").select(*node, F.coalesce("idom", "_root").alias("idom"))
        return Tables(e.sparkSession).keep(into.where("_n = 1").select(*node, F.col("up").alias("idom")).unionByName(of_joins))


def frontiers(e: DataFrame, idom: DataFrame, entry: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """(fn, node, join): ``node`` dominates a predecessor of ``join``, but not ``join`` itself or is it.

    From each predecessor of a node, rows climb the dominator tree until they meet the node's
    own immediate dominator; there are as many as the frontiers have members.
    """
    fn = list(fn)
    known = idom.select(*fn, "node", "idom").unionByName(entry.select(*fn, "node").distinct().withColumn("idom", F.lit(None).cast(idom.schema["idom"].dataType)))
    known = Tables(e.sparkSession).keep(known)
    rows = e.select(*fn, F.col("src").alias("node"), F.col("dst").alias("join")).distinct().join(known.select(*fn, "node"), [*fn, "node"], "left_semi")
    rows = rows.join(known.select(*fn, F.col("node").alias("join"), F.col("idom").alias("_stop")), [*fn, "join"])
    here = F.col("_stop").isNull() | (F.col("node") != F.col("_stop"))
    up = known.where("idom is not null")
    step = lambda d: d.join(up, [*fn, "node"]).select(*fn, F.col("idom").alias("node"), "join", "_stop").where(here)
    return close_rows(rows.select(*fn, "node", "join", "_stop").where(here), step).select(*fn, "node", "join")


def phi_places(defs: DataFrame, frontier: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """(fn, var, node): where definitions of a variable meet.

    ``defs``: (fn, var, node).  A phi instruction is a definition, too, so its own
    frontier follows.  Whether the variable is live there is not asked.
    """
    fn = list(fn)
    step = lambda d: d.join(frontier, [*fn, "node"]).select(*fn, "var", F.col("join").alias("node"))
    return close_rows(step(defs.select(*fn, "var", "node").distinct()).distinct(), step)
