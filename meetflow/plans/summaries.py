"""Facts across calls by function summaries.

A path edge says: what a variable holds before a node may be what an origin
holds, and the origin is a parameter's value at the function's entry or the
address of an object taken inside.  Path edges at a function's exit are its
summary; they don't depend on who calls.  A caller applies a callee's summary with
its own arguments in place of the parameters, so calls and returns always match.
Functions that call each other wait for nothing: new path edges at a call and new
rows of a summary meet all known ones of the other kind, until neither grows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Tables, close_rows

PATH = ["function", "param", "object", "node", "var"]


class Program:
    """Functions whose variables hold addresses.

    edges (function, src, dst); bounds (function, entry, exit).
    moves (function, node, target, source, object): at the node target gets what
    source holds, the address of object, or, with neither, something else; several
    rows of a target are several possibilities; the old value goes.
    calls (function, node, callee); args (function, node, param, arg); results
    (function, node, target, result): after the call target holds what the callee's
    variable result holds at its exit.  Variables that calls don't set keep their
    values.  Globals are parameters and results of their own name.  Calls of
    functions without bounds set their targets to something else.
    """

    def __init__(self, edges: DataFrame, bounds: DataFrame, moves: DataFrame, calls: DataFrame, args: DataFrame, results: DataFrame) -> None:
        self.edges, self.bounds, self.moves, self.calls, self.args, self.results = edges, bounds, moves, calls, args, results


def path_edges(p: Program, inputs: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(function, param, object, node, var): before the node var may hold what param held at entry, or the address of object.

    One of param and object is null.  Parameters are those that calls give, and
    ``inputs`` (function, param).  Each join has a key of the program (function,
    node, variable), so nothing meets in one task that grows with the callers but
    the summary of a function that many call, which is a join that may be split.
    """
    hop = p.edges.select("function", F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    site = p.calls.select("function", "node", "callee").distinct()
    gets = p.args.join(site, ["function", "node"]).select("function", "node", F.col("arg").alias("var"), "callee", F.col("param").alias("_param")).distinct()
    gives = p.results.join(site, ["function", "node"]).select("function", "node", "callee", "result", "target").distinct()
    kills = p.moves.select("function", "node", F.col("target").alias("var")).unionByName(p.results.select("function", "node", F.col("target").alias("var"))).distinct()
    copies = p.moves.where("source is not null").select("function", "node", F.col("source").alias("var"), "target").distinct()
    taken = p.moves.where("object is not null").select("function", "node", "target", "object").distinct()
    wanted = gets.select(F.col("callee").alias("function"), F.col("_param").alias("param"))
    if inputs is not None:
        wanted = wanted.unionByName(inputs.select("function", "param"))
    param, object_ = p.args.schema["param"].dataType, p.moves.schema["object"].dataType
    none = lambda kind: F.lit(None).cast(kind)

    with Tables(p.edges.sparkSession) as t:
        hop, gets, gives, kills, copies, exits = map(t.keep, (hop, gets, gives, kills, copies, p.bounds.select("function", F.col("exit").alias("node"))))
        seed = wanted.distinct().join(p.bounds, "function").select("function", "param", none(object_).alias("object"), F.col("entry").alias("node"), F.col("param").alias("var"))
        seed = seed.unionByName(taken.join(hop, ["function", "node"]).select("function", none(param).alias("param"), "object", F.col("_next").alias("node"), F.col("target").alias("var")))

        def on(d: DataFrame) -> DataFrame:
            """What comes out of a node, as path edges before the nodes after it."""
            return d.join(hop, ["function", "node"]).select("function", "param", "object", F.col("_next").alias("node"), "var")

        def step(delta: DataFrame, known: DataFrame) -> DataFrame:
            here = ["function", "node", "var"]
            out = delta.join(kills, here, "left_anti")
            out = out.unionByName(delta.join(copies, here).select("function", "param", "object", "node", F.col("target").alias("var")))

            def summary(d: DataFrame) -> DataFrame:
                return d.join(exits, ["function", "node"], "left_semi").select(F.col("function").alias("callee"), F.col("param").alias("_param"), F.col("object").alias("_object"), F.col("var").alias("result"))

            def apply(at_call: DataFrame, made: DataFrame) -> DataFrame:
                """Arguments at calls go through what the callee makes of its parameters."""
                through = at_call.join(gets, here).drop("var").join(made.where("_param is not null").drop("_object"), ["callee", "_param"])
                return through.join(gives, ["function", "node", "callee", "result"]).select("function", "param", "object", "node", F.col("target").alias("var"))

            new = summary(delta)
            out = out.unionByName(apply(delta, summary(known))).unionByName(apply(known, new))
            made = new.where("_object is not null").join(gives, ["callee", "result"])
            out = out.unionByName(made.select("function", none(param).alias("param"), F.col("_object").alias("object"), "node", F.col("target").alias("var")))
            return on(out)

        return close_rows(seed.select(PATH), step, most_rounds, with_known=True)


def summaries(paths: DataFrame, bounds: DataFrame) -> DataFrame:
    """(function, param, object, result): what variables hold at the exit, by what came in."""
    at = paths.join(bounds.select("function", F.col("exit").alias("node")), ["function", "node"])
    return at.select("function", "param", "object", F.col("var").alias("result"))


def entry_values(p: Program, paths: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(function, param, object): addresses that parameters may hold, from all calls of a function; ``inputs``: what they hold at the start."""
    at_calls = paths.join(p.args.withColumnsRenamed({"arg": "var", "param": "_to"}), ["function", "node", "var"]).join(p.calls, ["function", "node"])
    at_calls = at_calls.select("function", "param", "object", "callee", "_to").distinct()
    own = at_calls.where("object is not null").select(F.col("callee").alias("function"), F.col("_to").alias("param"), "object")
    if inputs is not None:
        own = own.unionByName(inputs.select("function", "param", "object"))
    with Tables(paths.sparkSession) as t:
        passed = t.keep(at_calls.where("param is not null").drop("object"))
        return close_rows(own, lambda d: d.join(passed, ["function", "param"]).select(F.col("callee").alias("function"), F.col("_to").alias("param"), "object"))


def points_to_across_calls(p: Program, inputs: DataFrame | None = None) -> DataFrame:
    """(function, node, var, object): addresses that variables may hold before nodes, over all calls whose returns match.

    ``inputs`` (function, param, object): what parameters hold where nothing calls.
    """
    paths = path_edges(p, None if inputs is None else inputs.select("function", "param").distinct())
    values = entry_values(p, paths, inputs)
    own = paths.where("object is not null").select("function", "node", "var", "object")
    return own.unionByName(paths.where("param is not null").drop("object").join(values, ["function", "param"]).select("function", "node", "var", "object")).distinct()
