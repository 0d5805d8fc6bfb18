"""Linking units, call sites and the call graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import numbered
from ..operators.sets import expand


def link(units: Sequence[DataFrame], name: str, defined: str) -> DataFrame:
    """One row for each global name of all units: a definition before a declaration, then the first unit."""
    stacked = None
    for n, unit in enumerate(units):
        unit = unit.withColumn("unit", F.lit(n))
        stacked = unit if stacked is None else stacked.unionByName(unit)
    w = Window.partitionBy(name).orderBy(F.col(defined).desc(), "unit")
    return stacked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def call_arguments(calls: DataFrame, keys: Sequence[str], args: str = "args") -> DataFrame:
    """(site, pos, arg): a site for each call, numbered over the keys."""
    if len(keys) == 1:
        sites = numbered(calls, keys, "site")
    else:
        sites = calls.withColumn("site", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])))
    return sites.select(*keys, "site", F.posexplode(args).alias("pos", "arg"))


def call_graph(calls: DataFrame, address_taken: DataFrame | None = None) -> DataFrame:
    """(caller, callee): direct calls, and for calls through a pointer every function whose address is taken.

    ``calls``: (caller, callee, pointer); ``address_taken``: (pointer, callee), what each pointer may be.
    Functions that the same pointers may be are a class, so every function is in one; callers meet
    classes once, and their pairs, far more rows than went in, are distinct as they are made.
    """
    direct = calls.where("callee is not null").select("caller", "callee").distinct()
    if address_taken is None:
        return direct
    alike = address_taken.where("pointer is not null").groupBy("callee").agg(F.array_sort(F.collect_set("pointer")).alias("_class"))
    classes = alike.select("_class").distinct().select("_class", F.explode("_class").alias("pointer"))
    through = calls.where("callee is null").select("caller", "pointer").distinct().join(classes, "pointer").select("caller", "_class").distinct()
    t = through.select(F.col("caller").alias("_caller"), F.col("_class").alias("_reached"))
    only = direct.join(alike, "callee", "left").join(t, F.col("caller").eqNullSafe(F.col("_caller")) & (F.col("_class") == F.col("_reached")), "left_anti")
    pairs = expand(through, alike, "_class", "caller")
    return only.select("caller", "callee").unionByName(pairs.select("caller", "callee"))


def contexts(call_edges: DataFrame, entry: str, depth: int = 2) -> DataFrame:
    """(function, context): call strings of at most ``depth`` sites that lead to a function from the entry.

    ``call_edges``: (caller, site, callee).
    """
    from .rounds import close_rows

    spark = call_edges.sparkSession
    seed = spark.createDataFrame([(entry, [])], "function string, context array<string>")
    e = call_edges.select(F.col("caller").alias("function"), F.col("site").cast("string").alias("_s"), "callee")
    push = F.slice(F.concat(F.array("_s"), "context"), 1, depth)
    return close_rows(seed, lambda d: d.join(e, "function").select(F.col("callee").alias("function"), push.alias("context")))


def supergraph(e: DataFrame, calls: DataFrame, bounds: DataFrame, *, main: str, depth: int = 0, skip_calls: bool = False) -> tuple[DataFrame, DataFrame]:
    """One graph of all functions, cloned by call strings of at most ``depth`` sites.

    e: (function, src, dst, label) within functions; calls: (function, node, callee);
    bounds: (function, entry, exit).  Returns edges (src, dst, label) over node
    names and the nodes (id, function, context, node).  A call node leads to its
    callees' entries and their exits lead to what follows the call; with
    ``skip_calls`` control also passes over it.  Calls to functions without bounds
    are passed over in any case.
    """
    known = calls.join(bounds.select(F.col("function").alias("callee")), "callee", "left_semi")
    site = F.concat_ws(":", "function", F.col("node").cast("string"))
    ctx = contexts(known.select(F.col("function").alias("caller"), site.alias("site"), "callee"), main, depth) if depth else None
    if ctx is None:
        ctx = bounds.select("function", F.array().cast("array<string>").alias("context"))
    name = lambda f, c, n: F.concat(f, F.lit("@"), F.array_join(c, "/"), F.lit("#"), n.cast("string"))
    inner = e if skip_calls else e.join(known.select("function", F.col("node").alias("src")).distinct(), ["function", "src"], "left_anti")
    inner = inner.join(ctx, "function").select(name(F.col("function"), F.col("context"), F.col("src")).alias("src"), name(F.col("function"), F.col("context"), F.col("dst")).alias("dst"), "label")
    pushed = F.slice(F.concat(F.array(site), "context"), 1, depth) if depth else F.col("context")
    at = known.join(ctx, "function").select("function", "node", "callee", "context", pushed.alias("_inner"))
    at = at.join(bounds.select(F.col("function").alias("callee"), "entry", "exit"), "callee")
    zero = F.lit(0).cast(e.schema["label"].dataType).alias("label")
    go = at.select(name(F.col("function"), F.col("context"), F.col("node")).alias("src"), name(F.col("callee"), F.col("_inner"), F.col("entry")).alias("dst"), zero)
    after = e.select("function", F.col("src").alias("node"), F.col("dst").alias("_next"))
    back = at.join(after, ["function", "node"]).select(name(F.col("callee"), F.col("_inner"), F.col("exit")).alias("src"), name(F.col("function"), F.col("context"), F.col("_next")).alias("dst"), zero)
    nodes = e.select("function", F.col("src").alias("node")).union(e.select("function", "dst")).union(bounds.select("function", "entry")).union(bounds.select("function", "exit")).distinct()
    nodes = nodes.join(ctx, "function").select(name(F.col("function"), F.col("context"), F.col("node")).alias("id"), "function", "context", "node")
    return inner.unionByName(go).unionByName(back).distinct(), nodes
