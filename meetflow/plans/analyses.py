"""Analyses: two-point reachability, strong liveness, intervals, points-to.

Facts are rows.  Node columns may be several (unit, function, node): ``fn`` names
those before ``src``/``dst`` of an edge table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.kinds import EdgeLabel
from ..functions.kinds import ExprKind as X
from ..operators import ranges
from .rounds import Tables, close_rows, close_values
from .views import cascade


#: A variable that stands for a whole set of variables (the globals of a unit).
UNIVERSE = -2


def reach(e: DataFrame, start: DataFrame, fn: Sequence[str] = (), *, backward: bool = False, through: DataFrame | None = None) -> DataFrame:
    """Nodes (fn, node) reached from ``start``: where bottom flows.  ``through`` lists nodes that pass nothing on (barriers)."""
    fn = list(fn)
    a, b = ("dst", "src") if backward else ("src", "dst")
    hop = e.select(*fn, F.col(a).alias("node"), F.col(b).alias("_next")).distinct()
    if through is not None:
        hop = hop.join(through.select(*fn, "node"), [*fn, "node"], "left_anti")
    with Tables(e.sparkSession) as t:
        hop = t.keep(hop)
        return close_rows(start.select(*fn, "node"), lambda d: d.join(hop, [*fn, "node"]).select(*fn, F.col("_next").alias("node")))


def reach_contracted(e: DataFrame, start: DataFrame, fn: Sequence[str] = (), most_levels: int = 64) -> DataFrame:
    """What ``reach`` gives, in rounds that follow the logarithm of chains.

    A node with one predecessor that is no start is reached exactly if that is.
    Such nodes hang on it, and doubling jumps find what each hangs on in the end;
    nodes of cycles that hang on each other are never reached.  Edges between what
    others hang on are the next, smaller graph.  Levels end when few nodes are
    saved; what is left is walked, and nodes follow what they hang on.
    Each level adds one row a node, no edges.
    """
    fn = list(fn)
    node = [*fn, "node"]
    with Tables(e.sparkSession) as t:
        here = t.keep(start.select(*node).distinct())
        edges, path, n = t.put(e.select(*fn, "src", "dst").where("src <> dst").distinct())
        hangs = []
        for _ in range(most_levels):
            one = edges.groupBy(*fn, F.col("dst").alias("node")).agg(F.min("src").alias("up"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
            up, _, hung = t.put(one.join(here, node, "left_anti"))
            if hung * 8 < n or not hung:
                break
            for _ in range(hung.bit_length() + 1):  # a node's jump becomes that of what it jumps to
                far = up.select(*fn, F.col("node").alias("up"), F.col("up").alias("_far"))
                up, _, moved = t.put(up.select(*node, "up").join(far, [*fn, "up"], "left").select(*node, F.coalesce("_far", "up").alias("up"), F.col("_far").isNotNull().alias("_moved")), "_moved")
                if not moved:
                    break
            up = up.where("not _moved").drop("_moved")  # after so many jumps only cycles go on
            hangs.append(up)
            top = up.select(*fn, F.col("node").alias("src"), F.col("up").alias("_top"))
            kept = edges.join(one.join(here, node, "left_anti").select(*fn, F.col("node").alias("dst")), [*fn, "dst"], "left_anti")
            kept = kept.join(top, [*fn, "src"], "left").select(*fn, F.coalesce("_top", "src").alias("src"), "dst").where("src <> dst").distinct()
            edges, path, n = t.put(kept)
        found = reach(edges, here, fn)
        for up in reversed(hangs):
            found = t.keep(found.unionByName(up.join(found.select(*fn, F.col("node").alias("up")), [*fn, "up"]).select(*node)).distinct())
        return Tables(e.sparkSession).keep(found)


def block_liveness(uses: DataFrame, e: DataFrame, fn: Sequence[str], *, exit_live: DataFrame | None = None) -> DataFrame:
    """Live variables at the entry of blocks, from composed transfers of blocks.

    ``uses``: (fn, bb, seq, var, is_def); an instruction that uses and defines a
    variable uses it first.  Per block and variable the first event decides: a use
    makes it live at entry, a definition kills it; blocks without an event pass it
    on.  ``exit_live``: (fn, bb, var) live at the end of blocks.
    """
    fn = list(fn)
    first = uses.groupBy(*fn, "bb", "var").agg(F.min(F.struct("seq", "is_def"))["is_def"].alias("kills"))
    seed = first.where("not kills").select(*fn, "bb", "var")
    hop = e.select(*fn, F.col("dst").alias("bb"), F.col("src").alias("_prev")).distinct()
    kills = first.where("kills").select(*fn, "bb", "var")
    if exit_live is not None:
        seed = seed.unionByName(exit_live.select(*fn, "bb", "var").join(kills, [*fn, "bb", "var"], "left_anti"))
    back = lambda d: d.join(hop, [*fn, "bb"]).select(*fn, F.col("_prev").alias("bb"), "var").join(kills, [*fn, "bb", "var"], "left_anti")
    with Tables(e.sparkSession) as t:
        hop, kills = t.keep(hop), t.keep(kills)
        return close_rows(seed, back)


def liveness(insn: DataFrame, uses: DataFrame, e: DataFrame, fn: Sequence[str], *, exit_live: DataFrame | None = None) -> DataFrame:
    """(fn, seq, var): variables live before each instruction.

    Blocks are solved first; inside a block the next event of a variable decides,
    or, where there is none, whether a successor has it live at entry.
    """
    fn = list(fn)
    entry = block_liveness(uses, e, fn, exit_live=exit_live)
    out = e.join(entry.withColumnRenamed("bb", "dst"), [*fn, "dst"]).select(*fn, F.col("src").alias("bb"), "var")
    if exit_live is not None:
        out = out.unionByName(exit_live.select(*fn, "bb", "var"))
    out = out.distinct().withColumn("_out", F.lit(True))
    per_block = uses.select(*fn, "bb", "var").unionByName(out.select(*fn, "bb", "var")).distinct()
    grid = insn.select(*fn, "bb", "seq").join(per_block, [*fn, "bb"])
    ev = uses.groupBy(*fn, "bb", "seq", "var").agg(F.bool_and("is_def").alias("is_def"))
    grid = grid.join(ev, [*fn, "bb", "seq", "var"], "left").join(out, [*fn, "bb", "var"], "left")
    w = Window.partitionBy(*fn, "bb", "var").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nxt = F.first("is_def", ignorenulls=True).over(w)
    return grid.withColumn("_live", F.coalesce(~nxt, F.col("_out"), F.lit(False))).where("_live").select(*fn, "seq", "var")


def strong_liveness(effects: DataFrame, e: DataFrame, fn: Sequence[str] = (), *, exit_live: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """(fn, node, var): strongly live before a node.

    ``effects``: (fn, node, target, source, always).  A row with ``always`` makes
    its source live (uses, returns, conditions, stores, arguments); a row with a
    target makes its source live only if the target is live after the node, and
    the target's own fact ends there (source null: kill alone, target ``*`` or -1:
    kill everything).  ``exit_live``: (fn, node, var) live after exit nodes.

    ``universe`` (one or more of fn, var): what the variable ``UNIVERSE`` stands for, in
    ``effects`` and ``exit_live`` and in the result, where it means all of them that
    the function doesn't assign (``expanded`` gives rows for each).  Those that it
    assigns are followed one by one, so rows depend on the functions' own
    instructions and not on the size of the universe.
    """
    fn = list(fn)
    with Tables(e.sparkSession) as t:
        effects = t.keep(effects.select(*fn, "node", "target", "source", "always"))
        kill = effects.where("target is not null").select(*fn, "node", F.col("target").alias("var")).distinct()
        kill_all = t.keep(kill.where("cast(var as string) in ('*', '-1')").select(*fn, "node").distinct())
        kill_one = t.keep(kill.where("cast(var as string) not in ('*', '-1')"))
        feed = t.keep(effects.where("target is not null and source is not null and not always").select(*fn, "node", F.col("target").alias("var"), F.col("source").alias("_src")).distinct())
        seed = effects.where("always and source is not null").select(*fn, "node", F.col("source").alias("var"))
        hop = t.keep(e.select(*fn, F.col("dst").alias("node"), F.col("src").alias("_prev")).distinct())

        def before(out: DataFrame) -> DataFrame:
            passed = out.join(kill_one, [*fn, "node", "var"], "left_anti").join(kill_all, [*fn, "node"], "left_anti")
            return passed.unionByName(out.join(feed, [*fn, "node", "var"]).select(*fn, "node", F.col("_src").alias("var")))

        ends = None if exit_live is None else exit_live.select(*fn, "node", "var")
        if universe is not None:
            universe = t.keep(universe)
            own = t.keep(assigned(effects, universe, fn))
            each = lambda d: d.unionByName(d.where(F.col("var") == UNIVERSE).select(*fn, "node").join(own, fn).select(*fn, "node", "var"))
            seed, ends = each(seed), None if ends is None else each(ends)
        if ends is not None:
            seed = seed.unionByName(before(ends))
        live = close_rows(seed, lambda d: before(d.join(hop, [*fn, "node"]).select(*fn, F.col("_prev").alias("node"), "var")))
        if universe is None:
            return live
        # one by one, variables of the universe that aren't assigned say nothing where all of them are live
        within = [c for c in universe.columns if c in fn]
        spare = live.join(universe, [*within, "var"], "left_semi").join(own, [*fn, "var"], "left_anti").join(live.where(F.col("var") == UNIVERSE).select(*fn, "node"), [*fn, "node"], "left_semi")
        return Tables(e.sparkSession).keep(live.join(spare.select(*fn, "node", "var"), [*fn, "node", "var"], "left_anti"))


def assigned(effects: DataFrame, universe: DataFrame, fn: Sequence[str]) -> DataFrame:
    """(fn, var): variables of the universe that a function's own instructions assign."""
    within = [c for c in universe.columns if c in fn]
    return effects.where("target is not null").select(*fn, F.col("target").alias("var")).distinct().join(universe, [*within, "var"], "left_semi")


def expanded(live: DataFrame, effects: DataFrame, universe: DataFrame, fn: Sequence[str]) -> DataFrame:
    """Rows of ``UNIVERSE`` as rows of its variables; as many as there are, for small results."""
    fn = list(fn)
    within = [c for c in universe.columns if c in fn]
    many = live.where(F.col("var") == UNIVERSE).drop("var").join(universe, within)
    many = many.join(assigned(effects, universe, fn), [*fn, "var"], "left_anti").select(*fn, "node", "var")
    return live.where(F.col("var") != UNIVERSE).unionByName(many).distinct()


def points_to(address: DataFrame, copy: DataFrame, load: DataFrame | None = None, store: DataFrame | None = None, most_rounds: int = 10_000,
              near: Sequence[str] = (), most_rows: int = 1_000) -> DataFrame:
    """(p, x): what pointers may point to, over all program points together.

    address (p, x): p = &x; copy (p, q): p = q, also p = q + i; load (p, q):
    p = *q; store (p, q): *p = q.  Loads and stores are copy edges that what is
    found opens: targets found and edges are rows of one table, and each round
    joins the new ones of either with all of the other.

    ``near``: columns of all tables that deal rows into units, say files.  A unit
    of at most ``most_rows`` rows that holds no name of another's depends on no other
    and is solved in the task that holds it, without rounds; all other rows go by
    rounds, together.  The result is the same.
    """
    if near:
        with_units = [(kind, d) for kind, d in enumerate((address, copy, load, store)) if d is not None]
        rows = reduce(DataFrame.unionByName, [d.select(F.xxhash64(*near).alias("unit"), F.lit(kind).alias("kind"), "p", F.col("q" if kind else "x").alias("x")) for kind, d in with_units])
        t = Tables(address.sparkSession)  # the result reads them
        rows = t.keep(rows)
        rest, n = t.put(entangled(t, rows, most_rows))[::2]
        if not n:
            return solved(rows)
        back = rows.join(rest, "unit", "left_semi")
        back = [back.where(F.col("kind") == kind).select("p", F.col("x").alias("q" if kind else "x")) for kind in range(4)]
        by_rounds = points_to(*back[:2], None if load is None else back[2], None if store is None else back[3], most_rounds)
        return solved(rows.join(rest, "unit", "left_anti")).unionByName(by_rounds)
    if load is None and store is None:
        hop = copy.select("p", F.col("q").alias("_q")).distinct()
        with Tables(address.sparkSession) as t:
            hop = t.keep(hop)
            return close_rows(address.select("p", "x"), lambda d: d.withColumnRenamed("p", "_q").join(hop, "_q").select("p", "x"), most_rounds)

    def target(p: str, x: str) -> list[Column]:
        return [F.lit(False).alias("edge"), F.col(p).alias("p"), F.col(x).alias("x")]

    def edge(p: str, q: str) -> list[Column]:
        return [F.lit(True).alias("edge"), F.col(p).alias("p"), F.col(q).alias("x")]

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        found = delta.where("not edge").select(F.col("p").alias("_p"), F.col("x").alias("_x"))
        opened = delta.where("edge").select(F.col("p").alias("_to"), F.col("x").alias("_p"))
        edges = known.where("edge").select(F.col("p").alias("_to"), F.col("x").alias("_p"))
        targets = known.where("not edge").select(F.col("p").alias("_p"), F.col("x").alias("_x"))
        out = found.join(edges, "_p").unionByName(targets.join(opened, "_p")).select(*target("_to", "_x"))
        if load is not None:
            out = out.unionByName(loads.join(found, "_p").select(*edge("_to", "_x")))
        if store is not None:
            out = out.unionByName(stores.join(found, "_p").select(*edge("_x", "_from")))
        return out

    with Tables(address.sparkSession) as t:
        if load is not None:
            loads = t.keep(load.select(F.col("p").alias("_to"), F.col("q").alias("_p")).distinct())
        if store is not None:
            stores = t.keep(store.select(F.col("p").alias("_p"), F.col("q").alias("_from")).distinct())
        seed = address.select(*target("p", "x")).unionByName(copy.select(*edge("p", "q")))
        return close_rows(seed, step, most_rounds, with_known=True).where("not edge").select("p", "x")


def entangled(t: Tables, rows: DataFrame, most_rows: int) -> DataFrame:
    """Units of rows (unit, kind, p, x) that hold a name which another holds, too, or point to null, or hold more than ``most_rows`` rows."""
    names = rows.select("unit", F.explode(F.array("p", "x")).alias("v"))
    shared = names.where("v is not null").groupBy("v").agg(F.min("unit").alias("_a"), F.max("unit").alias("_b")).where("_a <> _b").select("v")
    shared, _, n = t.put(shared)
    null = F.expr("kind = 0 and x is null")  # a null name that holds null may come from any of them
    own = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(null).alias("_null")).where((F.col("_n") > most_rows) | F.col("_null")).select("unit")
    return own.unionByName(names.join(shared, "v", "left_semi").select("unit")).distinct() if n else own


def solved(rows: DataFrame) -> DataFrame:
    """(p, x) of ``points_to`` for rows (unit, kind, p, x), kind 0 to 3 for address, copy, load and store, of units that depend on no other.

    Spark brings a unit's rows together; a task reads one unit after the other.
    Names are numbered within a unit, sets are bits of an integer, and a name
    passes on what it got since it last did.  A null name gets, but gives nothing,
    as null keys join with nothing.
    """

    def solve(batches):
        from itertools import groupby

        import pyarrow as pa

        def bits(m):
            while m:
                low = m & -m
                yield low.bit_length() - 1
                m ^= low

        def unit(rows):
            ids: dict = {}
            rows = [(kind, ids.setdefault(p, len(ids)), ids.setdefault(x, len(ids))) for _, kind, p, x in rows]
            none, todo = ids.get(None), []
            holds, new, to = ([0] * len(ids) for _ in range(3))
            loads, stores = ([[] for _ in ids] for _ in range(2))

            def give(p, targets):
                fresh = targets & ~holds[p]
                if fresh:
                    holds[p] |= fresh
                    if not new[p] and p != none:
                        todo.append(p)
                    new[p] |= fresh

            def link(q, p):
                if q != none and not to[q] >> p & 1:
                    to[q] |= 1 << p
                    give(p, holds[q])

            for kind, p, x in rows:
                if kind == 0:
                    give(p, 1 << x)
                elif kind == 1:
                    link(x, p)
                else:
                    (loads[x] if kind == 2 else stores[p]).append(p if kind == 2 else x)
            while todo:
                v = todo.pop()
                got, new[v] = new[v], 0
                for p in bits(to[v]):
                    give(p, got)
                for x in bits(got) if loads[v] or stores[v] else ():
                    for p in loads[v]:
                        link(x, p)
                    for q in stores[v]:
                        link(q, x)
            return list(ids), holds

        kinds = []

        def read():
            for b in batches:
                kinds[:] = b.schema.types[2:]
                yield from zip(*[c.to_pylist() for c in b.columns])

        found: tuple[list, list] = ([], [])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["p", "x"])
        for _, group in groupby(read(), lambda r: r[0]):
            names, holds = unit(group)
            for p, targets in zip(names, holds):
                found[0].extend([p] * targets.bit_count())
                found[1].extend([names[x] for x in bits(targets)])
                if len(found[0]) >= 50_000:
                    yield batch()
                    found = ([], [])
        if found[0]:
            yield batch()

    dealt = rows.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(solve, StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name in ("p", "x")]))


def interval(assigns: DataFrame, e: DataFrame, fn: Sequence[str] = (), *, entry: DataFrame, full: tuple[int, int],
             widen_after: int = 8, refine: Callable | None = None, reached: DataFrame | None = None, heads: DataFrame | None = None, narrow: int = 0) -> DataFrame:
    """(fn, node, var, lo, hi): ranges after each node, forward; missing rows are top.

    ``assigns``: (fn, node, var, xkind, a_var, a_const, b_var, b_const, weak): var =
    a op b with variables or constants (XVAL takes a alone); a weak update meets
    the value before (array elements, pointers with several targets).  Results
    outside ``full`` widen to ``full`` (C leaves overflow open).  ``entry``: (fn,
    node, var, lo, hi) before entry nodes.  ``refine`` may narrow what flows
    along an edge: it gets rows (fn, src, dst, label, var, lo, hi) and returns them.
    ``reached`` (fn, node): the only nodes that take part, if given.  ``heads`` (fn,
    node): only there values widen, each end by itself (``graph.loop_heads`` meets every cycle).  Up to
    ``narrow`` rounds then take back what widening lost: values are found anew from
    those before them, which only makes them smaller, until none changes.
    The transfer of operators follows C on bounds; what the domain cannot say is ``full``.
    """
    fn = list(fn)
    lo_all, hi_all = F.lit(full[0]).cast("long"), F.lit(full[1]).cast("long")
    node = [*fn, "node"]
    if reached is not None:
        assigns, e = assigns.join(reached, node, "left_semi"), cascade(e, reached, fn)
    tables = Tables(e.sparkSession)
    assigns, e = tables.keep(assigns.withColumn("_aid", F.monotonically_increasing_id())), tables.keep(e)
    # what a value before a node is there for: operands of assignments, and whether it ends there
    reads = [assigns.where(f"{x}_const is null and {x}_var is not null").select(*node, F.col(f"{x}_var").alias("var"), F.lit(False).alias("_ends"), F.struct("_aid", F.lit(x).alias("_side"), "var").alias("_use")) for x in "ab"]
    ends = assigns.where("not weak").select(*node, "var", F.lit(True).alias("_ends"))
    roles = reads[0].unionByName(reads[1]).unionByName(ends, allowMissingColumns=True).groupBy(*node, "var")
    roles = tables.keep(roles.agg(F.bool_or("_ends").alias("_ends"), F.collect_list("_use").alias("_uses")))
    nodes_in = e.select(*fn, "src", F.col("dst"), *(["label"] if "label" in e.columns else []))

    def before(facts: DataFrame, nodes: DataFrame) -> DataFrame:
        flow = nodes_in.join(nodes.select(*fn, F.col("node").alias("dst")), [*fn, "dst"]).join(facts.withColumnRenamed("node", "src"), [*fn, "src"])
        flow = refine(flow) if refine else flow
        own = entry.join(nodes, node, "left_semi")
        return flow.select(*fn, F.col("dst").alias("node"), "var", "lo", "hi").unionByName(own).groupBy(*node, "var").agg(*ranges.meet_all("lo", "hi"))

    # expressions are built once: on the driver they cost more than a round's small joins
    itself = F.array(F.struct(F.lit(None).cast("bigint").alias("_aid"), F.lit("").alias("_side"), F.col("var").alias("var")))
    uses = F.when(F.col("_ends").isNull(), itself).when(F.col("_ends"), F.col("_uses")).otherwise(F.concat(itself, F.col("_uses")))
    value = {f"{x}_{end}": F.max(F.when(F.col("_side") == x, F.col(end))) for x in ("", "a", "b") for end in ("lo", "hi")}
    for x in "ab":
        value |= {f"{x}_{end}": F.coalesce(F.max(f"{x}_const"), value[f"{x}_{end}"]) for end in ("lo", "hi")}
    value = [F.max("xkind").alias("xkind"), *[v.alias(k) for k, v in value.items()]]
    operands = [F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")]
    lo, hi = bounds_of(F.col("xkind"), *operands)
    made = [*node, "var", F.col("_aid").isNull().alias("_own"), "_lo", "_hi", known_operands(F.col("xkind"), *operands).alias("_known"), lo.alias("lo"), hi.alias("hi")]
    lo, hi = within(F.col("_known"), F.col("lo"), F.col("hi"), lo_all, hi_all)
    made_in = [*node, "var", F.when(F.col("_own"), F.col("_lo")).otherwise(lo).alias("lo"), F.when(F.col("_own"), F.col("_hi")).otherwise(hi).alias("hi")]

    def after(inside: DataFrame, nodes: DataFrame) -> DataFrame:
        """Values after nodes, several rows a variable; each value before them is looked at once."""
        moved = inside.join(roles, [*node, "var"], "left").select(*node, "lo", "hi", F.explode(uses).alias("_u"))
        moved = moved.select(*node, "_u.var", "_u._aid", "_u._side", "lo", "hi")
        todo = assigns.join(nodes, node, "left_semi").select(*node, "var", "_aid", "xkind", "a_const", "b_const")
        rows = moved.unionByName(todo, allowMissingColumns=True).groupBy(*node, "var", "_aid").agg(*value)
        return rows.select(*made).select(*made_in).where("lo is not null")

    def step(facts: DataFrame, changed: DataFrame) -> DataFrame:
        touched = e.join(changed.select(*fn, F.col("node").alias("src")).distinct(), [*fn, "src"], "left_semi").select(*fn, F.col("dst").alias("node")).distinct()
        return after(before(facts, touched), touched)

    def widen(rows: DataFrame) -> DataFrame:
        lo, hi = ranges.widen(F.col("old_lo"), F.col("old_hi"), F.col("lo"), F.col("hi"), lo_all, hi_all)
        may = F.col("_had").isNotNull()
        if heads is not None:  # an end that doesn't move stays, or narrowing could not find it again
            rows = rows.join(at, node, "left")
            may = may & F.col("_head").isNotNull()
            lo, hi = F.when(F.col("lo") < F.col("old_lo"), lo_all).otherwise(F.col("lo")), F.when(F.col("hi") > F.col("old_hi"), hi_all).otherwise(F.col("hi"))
        rows = rows.withColumn("_lo", F.when(may, lo).otherwise(F.col("lo"))).withColumn("_hi", F.when(may, hi).otherwise(F.col("hi")))
        return rows.drop("lo", "hi", "_head").withColumnsRenamed({"_lo": "lo", "_hi": "hi"})

    start = entry.select(*node).unionByName(assigns.select(*node)).distinct()
    seed = after(entry.groupBy(*node, "var").agg(*ranges.meet_all("lo", "hi")), start)
    with tables:
        if heads is not None:
            at = tables.keep(heads.select(*node).distinct().withColumn("_head", F.lit(True)))
        facts = close_values(seed, [*node, "var"], ["lo", "hi"], ranges.meet_all("lo", "hi"), step, widen=widen, widen_after=widen_after)
        result, again = Tables(e.sparkSession), tables.keep(start.unionByName(e.select(*fn, F.col("dst").alias("node"))).distinct())
        for _ in range(narrow):
            anew = after(before(facts, again), again).groupBy(*node, "var").agg(*ranges.meet_all("lo", "hi")).withColumn("_new", F.lit(True))
            old = facts.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(again, node, "left_semi")
            same = F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi"))
            both = old.join(anew, [*node, "var"], "left").withColumn("_moved", ~same)
            found, _, moved = tables.put(both, "_moved")
            if not moved:
                break
            rest = facts.join(again, node, "left_anti")
            facts = result.keep(rest.unionByName(found.where("_new").select(facts.columns)))
            again = tables.keep(e.join(found.where("_moved").select(*fn, F.col("node").alias("src")).distinct(), [*fn, "src"], "left_semi").select(*fn, F.col("dst").alias("node")).distinct())
        return facts


def branch_limits(conditions: DataFrame, fn: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """``refine`` of ``interval``: a comparison that a branch is taken by bounds its operands on either side.

    ``conditions``: (fn, node, xkind, a_var, a_const, b_var, b_const): node branches on a op b
    (see ``comparisons``).  x < y bounds x by y's upper end and y by x's lower end;
    the false side has the opposite comparison.  A side on which nothing remains of
    a range passes nothing of that variable on.
    """
    fn = list(fn)
    opposite = {int(X.LT): int(X.GE), int(X.GE): int(X.LT), int(X.EQ): int(X.NE), int(X.NE): int(X.EQ)}
    side = lambda s: (F.col(f"{s}_var"), F.col(f"{s}_const"))

    def limits(op: Column, label: EdgeLabel) -> list[Column]:
        """At most / at least rows: var, other, constant, upper, distance."""
        row = lambda s, o, upper, when, d: F.when(when, F.struct(F.lit(int(label)).alias("label"), side(s)[0].alias("var"), side(o)[0].alias("_other"), side(o)[1].alias("_const"), F.lit(upper).alias("_upper"), d.alias("_by")))
        lt, ge, eq = op == int(X.LT), op == int(X.GE), op == int(X.EQ)
        d = F.when(lt, 1).otherwise(0)
        return [row("a", "b", True, lt | eq, d), row("b", "a", False, lt | eq, d), row("a", "b", False, ge | eq, d), row("b", "a", True, ge | eq, d)]

    op = F.col("xkind")
    negated = F.coalesce(*[F.when(op == k, v) for k, v in opposite.items()])
    rows = conditions.select(*fn, F.col("node").alias("src"), F.inline(F.array_compact(F.array(*limits(op, EdgeLabel.TRUE), *limits(negated, EdgeLabel.FALSE))))).where("var is not null")

    def refine(flow: DataFrame) -> DataFrame:
        other = flow.select(*fn, "src", "label", F.col("var").alias("_other"), F.col("lo").alias("_olo"), F.col("hi").alias("_ohi")).distinct()
        at = [*fn, "src", "label"]
        own = rows.withColumn("label", F.col("label").cast(flow.schema["label"].dataType)).join(other, [*at, "_other"], "left")
        upper, lower = F.coalesce("_const", "_ohi") - F.col("_by"), F.coalesce("_const", "_olo") + F.col("_by")
        own = own.groupBy(*at, "var").agg(F.min(F.when(F.col("_upper"), upper)).alias("_most"), F.max(F.when(~F.col("_upper"), lower)).alias("_least"))
        out = flow.join(own, [*at, "var"], "left").withColumns({"lo": F.greatest("lo", "_least"), "hi": F.least("hi", "_most")}).where("lo <= hi")
        return out.select(flow.columns)

    return refine


def comparisons(branches: DataFrame, assigns: DataFrame, e: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """``conditions`` of ``branch_limits`` for branches (fn, node, var) on a variable that a comparison was put in.

    The comparison must be the variable's only assignment and lie right before the
    branch on every way to it, so that its operands still are what was compared.
    """
    fn = list(fn)
    only = assigns.join(assigns.groupBy(*fn, "var").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n"), [*fn, "var"], "left_semi")
    only = only.where(F.col("xkind").between(int(X.EQ), int(X.GE)) & ~F.col("a_var").eqNullSafe(F.col("var")) & ~F.col("b_var").eqNullSafe(F.col("var")))
    before = e.groupBy(*fn, F.col("dst").alias("node")).agg(F.min("src").alias("_def"), F.max("src").alias("_last")).where("_def = _last").drop("_last")
    found = branches.select(*fn, "node", "var").join(before, [*fn, "node"])
    return found.join(only.withColumnRenamed("node", "_def"), [*fn, "_def", "var"]).select(*fn, "node", "xkind", "a_var", "a_const", "b_var", "b_const")


def known_operands(x: Column, alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Whether no operand is top."""
    return alo.isNotNull() & (blo.isNotNull() | x.isin(int(X.VAL), int(X.NEGATE)))


def bounds_of(x: Column, alo: Column, ahi: Column, blo: Column, bhi: Column) -> tuple[Column, Column]:
    """Bounds of a op b as wide decimals; null where the operator says nothing."""
    wide = "decimal(38,0)"
    a, b, c, d = (v.cast("decimal(19,0)") for v in (alo, ahi, blo, bhi))
    products = [(p * q).cast(wide) for p in (a, b) for q in (c, d)]
    cases = [(X.VAL, a, b), (X.NEGATE, -b, -a), (X.ADD, a + c, b + d), (X.SUB, a - d, b - c), (X.MUL, F.least(*products), F.greatest(*products))]
    lo = hi = None
    for k, p, q in cases:
        p, q = p.cast(wide), q.cast(wide)
        lo = F.when(x == int(k), p) if lo is None else lo.when(x == int(k), p)
        hi = F.when(x == int(k), q) if hi is None else hi.when(x == int(k), q)
    truth = x.between(int(X.EQ), int(X.GE)) | (x == int(X.NOT))
    return lo.when(truth, F.lit(0).cast(wide)), hi.when(truth, F.lit(1).cast(wide))


def within(known: Column, lo: Column, hi: Column, lo_all: Column, hi_all: Column) -> tuple[Column, Column]:
    """The bounds; the full range where one leaves it or there are none; null (top) while an operand is top."""
    bad = lo.isNull() | (lo < lo_all) | (hi > hi_all)
    return F.when(known & bad, lo_all).when(known, lo.cast("long")), F.when(known & bad, hi_all).when(known, hi.cast("long"))
