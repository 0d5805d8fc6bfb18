"""Chat formatting with collapse of cumulative snapshots (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def collapse_and_render(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered.

    Turns are numbered by (turn, role, text).  The hash of a conversation's first
    k turns is the running XOR of 64-bit hashes of (k, role, text), kept twice
    with different seeds.  Of conversations with equal turns the one with the
    smallest id stays; one whose turns are the first turns of a longer one goes
    (left anti join of whole hashes with the distinct proper-prefix hashes).  The
    rest are rendered to one text each: a conversation is one output row, the only
    group that meets in a task.

    Null roles and texts are compared as values of their own and rendered as
    ``unknown`` and empty; rows without an id form one conversation with a null
    id; repeated rows are turns; an empty table gives no rows.  Returns id,
    n_turns and text.
    """
    c = conversations.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.col(role_col).alias("_r"), F.col(text_col).alias("_x"))
    order = Window.partitionBy("_c").orderBy(*[F.col(x).asc_nulls_first() for x in ("_t", "_r", "_x")])
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = c.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_c")))
    fields = [F.col("_k"), F.col("_r").isNull(), F.col("_x").isNull(), F.col("_r"), F.col("_x")]
    hashed = cut(numbered.select("_c", "_k", "_n", *[
        F.bit_xor(F.xxhash64(F.lit(seed), *fields)).over(upto).alias(name) for name, seed in (("_h1", 1), ("_h2", 2))]))
    key = ["_k", "_h1", "_h2"]
    proper = hashed.where("_k < _n").select(*key).distinct()
    whole = hashed.where("_k = _n").groupBy(*key).agg(F.min(F.struct(F.col("_c").isNull(), F.col("_c"))).alias("_first"))
    kept = whole.join(proper, key, "left_anti").select(F.col("_first._c").alias("_keep"))
    turns = c.join(kept, F.col("_c").eqNullSafe(F.col("_keep")), "left_semi")
    parts = F.sort_array(F.collect_list(F.struct("_t", "_r", "_x")))
    return turns.groupBy("_c").agg(parts.alias("_turns")).select(
        F.col("_c").alias(conv_col), F.size("_turns").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: render_turn(t["_r"], t["_x"])), "").alias("text"))
