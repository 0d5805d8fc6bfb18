"""Control-flow graphs from instruction rows, and graph queries.

``insn`` rows have unit, function and sequence columns (``fn`` names the columns
that name a function) and a kind; conditions and gotos have label ids, labels an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import EdgeLabel, InsnKind
from ..functions.scalars import has_call

I, L = InsnKind, EdgeLabel
#: A block of more instructions is allowed, but worth a warning.
BLOCK_LIMIT = 64
EXIT = -1


def blocks(insn: DataFrame, fn: Sequence[str], kind: str = "ikind", seq: str = "seq") -> DataFrame:
    """Adds ``bb``: blocks begin at labels and calls, after calls, conditions, gotos and returns, and at the start.

    Of several labels in a row only the first begins a block.
    """
    w = Window.partitionBy(*fn).orderBy(seq)
    k, before = F.col(kind), F.lag(kind).over(w)
    ends = has_call(before) | before.isin(int(I.COND), int(I.GOTO), int(I.RETURN))
    label = (k == int(I.LABEL)) & (F.coalesce(before, F.lit(-1)) != int(I.LABEL))
    call = has_call(k) & (before != int(I.LABEL))
    leader = before.isNull() | ends | label | call
    return insn.withColumn("bb", (F.sum(F.coalesce(leader, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def block_table(placed: DataFrame, fn: Sequence[str], seq: str = "seq") -> DataFrame:
    """First and last instruction of each block, its size, and whether it is the entry; size over 64 is flagged."""
    g = placed.groupBy(*fn, "bb").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).cast("int").alias("size"))
    return g.withColumn("is_entry", F.col("bb") == 0).withColumn("over_limit", F.col("size") > BLOCK_LIMIT)


def edges(placed: DataFrame, fn: Sequence[str], *, kind: str = "ikind", seq: str = "seq", label: str = "label", true: str = "true_label",
          false: str = "false_label", target: str = "target") -> DataFrame:
    """Edges between blocks: true and false of conditions, goto to its label, return to the exit, else the next block.

    A missing label leads to the exit, as do blocks without a successor.  An edge
    to the same or an earlier block by a jump is labelled as a back edge only when it has no
    other label.  The exit is block -1.
    """
    fn = list(fn)
    w = Window.partitionBy(*fn).orderBy(seq)
    last = placed.withColumn("_next", F.lead("bb").over(w)).where("_next is null or _next <> bb")
    where = placed.where(F.col(kind) == int(I.LABEL)).select(*fn, F.col(label).alias("_to"), F.col("bb").alias("_dst")).distinct()
    k = F.col(kind)
    jump = lambda col, lab: F.struct(F.col(col).alias("to"), F.lit(int(lab)).alias("label"), F.lit(None).cast("int").alias("bb"))
    plain = lambda bb: F.struct(F.lit(None).cast(placed.schema[target].dataType).alias("to"), F.lit(int(L.SIMPLE)).alias("label"), bb.cast("int").alias("bb"))
    out = (F.when(k == int(I.COND), F.array(jump(true, L.TRUE), jump(false, L.FALSE))).when(k == int(I.GOTO), F.array(jump(target, L.SIMPLE)))
           .when(k == int(I.RETURN), F.array(plain(F.lit(EXIT)))).otherwise(F.array(plain(F.coalesce(F.col("_next"), F.lit(EXIT))))))
    out = last.select(*fn, F.col("bb").alias("src"), F.explode(out).alias("_e")).select(*fn, "src", F.col("_e.to").alias("_to"), F.col("_e.label").alias("label"), F.col("_e.bb").alias("_bb"))
    out = out.join(where, [*fn, "_to"], "left").select(*fn, "src", F.coalesce("_bb", "_dst", F.lit(EXIT)).alias("dst"), "label")
    back = (F.col("label") == int(L.SIMPLE)) & (F.col("dst") >= 0) & (F.col("dst") <= F.col("src"))
    return out.withColumn("label", F.when(back, int(L.BACK)).otherwise(F.col("label")).cast("tinyint"))


def insn_edges(placed: DataFrame, bb_edges: DataFrame, fn: Sequence[str], seq: str = "seq") -> DataFrame:
    """Edges between instructions: to the next in the block, and from a block's last to the first of its successors."""
    fn = list(fn)
    w = Window.partitionBy(*fn, "bb").orderBy(seq)
    inner = placed.select(*fn, F.col(seq).alias("src"), F.lead(seq).over(w).alias("dst"), F.lit(0).cast("tinyint").alias("label")).where("dst is not null")
    b = placed.groupBy(*fn, "bb").agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    e = bb_edges.join(b.select(*fn, F.col("bb").alias("src"), "_last"), [*fn, "src"])
    e = e.join(b.select(*fn, F.col("bb").alias("dst"), "_first"), [*fn, "dst"])
    return inner.unionByName(e.select(*fn, F.col("_last").alias("src"), F.col("_first").alias("dst"), "label"))


def contract(e: DataFrame, drop: DataFrame, fn: Sequence[str], most: int = 10_000) -> DataFrame:
    """Edges without the nodes in ``drop`` (fn, node), which only pass facts on: their ends are joined through.

    An edge is followed over dropped nodes until it meets others, with the label it
    began with; dropped nodes may form cycles, which lead nowhere by themselves.
    Raises when ``most`` rounds do not suffice.
    """
    from ..plans.rounds import Tables, close_rows

    fn = list(fn)
    at = lambda name: drop.select(*fn, F.col("node").alias(name)).distinct()
    with Tables(e.sparkSession) as t:
        on = t.keep(e.join(at("src"), [*fn, "src"], "left_semi").select(*fn, F.col("src").alias("dst"), F.col("dst").alias("_far")).distinct())
        rows = close_rows(e.join(at("src"), [*fn, "src"], "left_anti").select(*fn, "src", "dst", "label"), lambda d: d.join(on, [*fn, "dst"]).select(*fn, "src", F.col("_far").alias("dst"), "label"), most)
    return rows.join(at("dst"), [*fn, "dst"], "left_anti").select(e.columns)


def loop_heads(e: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """(fn, node): where an edge leads back, or to itself, in the order of node numbers; every cycle has such a node."""
    return e.where("dst <= src").select(*fn, F.col("dst").alias("node")).distinct()


def successors(e: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    """Ordered lists, true before false."""
    return e.groupBy(*fn, "src").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "dst"))), lambda x: x["dst"]).alias("succ"))


def predecessors(e: DataFrame, fn: Sequence[str] = ()) -> DataFrame:
    return e.groupBy(*fn, "dst").agg(F.sort_array(F.collect_list("src")).alias("pred"))


def invalid_nodes(nodes: DataFrame, e: DataFrame, entry: DataFrame, exit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes that lack a predecessor (but entries) or a successor (but exits); a graph is valid if there are none."""
    keys = list(keys)
    fn, node = keys[:-1], keys[-1]
    no_pred = nodes.join(e.select(*fn, F.col("dst").alias(node)).distinct(), keys, "left_anti").join(entry, keys, "left_anti").withColumn("lacks", F.lit("predecessor"))
    no_succ = nodes.join(e.select(*fn, F.col("src").alias(node)).distinct(), keys, "left_anti").join(exit, keys, "left_anti").withColumn("lacks", F.lit("successor"))
    return no_pred.unionByName(no_succ)


def visiting_order(nodes: DataFrame, e: DataFrame, fn: Sequence[str], *, reverse_post: bool = True) -> DataFrame:
    """Position of each reachable node in (reverse) post-order of a depth-first walk, true successor first.

    The solver does not need it.  A walk is sequential, so it runs per function,
    all of whose edges meet in one task.
    """
    fn = list(fn)
    src = e.select(*fn, "src", "dst", "label").unionByName(nodes.select(*fn, F.lit(0).alias("src"), F.lit(None).cast(e.schema["dst"].dataType).alias("dst"), F.lit(None).cast("tinyint").alias("label")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in fn)

    def walk(key, pdf):
        import pandas as pd

        rows = pdf.dropna(subset=["dst"]).sort_values(["src", "label", "dst"])
        succ: dict = {}
        for s, d in zip(rows["src"], rows["dst"]):
            succ.setdefault(int(s), []).append(int(d))
        seen, post, todo = {0}, [], [(0, iter(succ.get(0, [])))]
        while todo:
            node, rest = todo[-1]
            nxt = next((d for d in rest if d not in seen), None)
            if nxt is None:
                todo.pop()
                post.append(node)
            else:
                seen.add(nxt)
                todo.append((nxt, iter(succ.get(nxt, []))))
        order = post[::-1] if reverse_post else post
        return pd.DataFrame({**{k: [v] * len(order) for k, v in zip(fn, key)}, "node": order, "position": range(len(order))})

    return src.groupBy(*fn).applyInPandas(walk, f"{kinds}, node int, position int")


def node_numbers(insn: DataFrame, fn: Sequence[str], skip: Column, seq: str = "seq", existing: str | None = None) -> DataFrame:
    """Adds ``node``: 1, 2, ... over a function's instructions that aren't skipped; an existing number is kept."""
    w = Window.partitionBy(*fn, skip).orderBy(seq)
    n = F.when(~skip, F.row_number().over(w))
    return insn.withColumn("node", F.coalesce(F.col(existing), n) if existing else n)
