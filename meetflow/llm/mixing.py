"""Mixing sources to target weights (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

WORD = r"[^\x20\x09-\x0D]+"

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of characters that are neither digits nor markup; 1 for empty texts."""
    plain = F.length(F.translate(text, "0123456789#$%&*|<>{}[]=_~^@\\!", ""))
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(plain / F.length(text), F.lit(0.05))), F.lit(1.0))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row a source: size, rows and target.

    Sources in code-point order (null last) get ``weights`` in turn and share
    ``share`` times all sizes; no target passes ``cap`` times its source's size
    and what is cut off is shared again by weight.  That is the level L with
    sum(min(cap*size, L*weight)) = share*total: sources sorted by cap*size/weight
    are full as long as that ratio stays below the level the rest would reach.
    The window without a key holds one row a source.
    """
    every = Window.partitionBy()
    src = sized.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    src = src.withColumn("_full", F.col("_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_full") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    src = src.withColumn("_level", rest / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = F.max("_level").over(every)  # the levels of the prefixes rise up to the right one and fall after it
    return src.select("_src", F.col("_size").alias("source_size"), "_rows", F.least("_full", level * F.col("_w")).alias("target"))


def document_key(id_col: str, quality: Column, seed: int) -> Column:
    """-ln(u)/quality, u in (0, 1) from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / quality


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns; those with maps, which have no hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))


#: What orders the documents of a source: the key, then whatever tells rows of one key apart.
ORDER = ["_key", "_id", "size", "_tie"]


def mixed_rows(docs: DataFrame, size: Column, quality: Column, weights: Sequence[float], share: float, cap: float, seed: int,
               id_col: str, source_col: str) -> DataFrame:
    """Every document's key, complete epochs and times; see ``mix_sources``.

    ``_part``, the partition a row was read in, is the last of the range columns,
    so rows that are equal in everything still spread over many ranges.
    """
    base = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"),
                           document_key(id_col, quality, seed).alias("_key"), source_key(source_col).alias("_src"),
                           whole_row(docs).alias("_tie"), F.spark_partition_id().alias("_part")))
    targets = cut(source_targets(base, weights, share, cap))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_epochs", epochs.cast("long")).withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    rows = cut(base.drop("source").repartitionByRange("_src", *ORDER, "_part").withColumn("_pid", F.spark_partition_id()))
    totals = rows.groupBy("_src", "_pid").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_src").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_src", "_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_below")).join(targets, "_src")
    running = Window.partitionBy("_src", "_pid").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_below") + F.col("_running") - F.col("size") / 2
    rows = rows.withColumn("_running", F.sum("size").over(running)).join(totals, ["_src", "_pid"])
    return rows.withColumn("times", F.col("_epochs") + ((F.col("size") > 0) & (middle <= F.col("_budget"))).cast("long"))


def mix_sources(docs: DataFrame, *, size: Column, quality: Column, weights: Sequence[float] = (5, 2, 1),
                share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """Efraimidis-Spirakis mix of sources to word targets.

    A document's key is -ln(u)/quality, u in (0, 1) from a hash of its id and
    ``seed``.  A source whose target holds k times its size gives every document
    k times (complete epochs); what remains is a budget for the documents with
    the smallest keys: sizes are prefix-summed in key order and a document is
    taken while its middle lies within the budget, so a source misses its target
    by at most half a document.  Rows are range-partitioned by source and key
    (then id, size, a hash of the whole row and the partition it came from, so
    equal keys spread, too); each range's size is added up first, rows are summed
    within a range after, so no source, however large, is sorted in one task.

    Returns id, size, source_size, target, taken (size times ``times``) and
    ``times`` (0, 1, 2, ...).  Null sources form a source, null ids and repeated
    rows are documents like others (equal ids have equal u; of rows that are
    equal in every column any may be taken), a source of only
    empty documents has target 0, an empty table gives no rows.
    """
    out = mixed_rows(docs, size, quality, weights, share, cap, seed, id_col, source_col)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


#: Sources whose thresholds (a name and two numbers) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def mix_documents(docs: DataFrame, *, size: Column, quality: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                  cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them: each ``times`` times, all columns as they were.

    Within a source the documents taken beyond complete epochs are those up to one
    place in the order of ``mix_sources``, so texts need not move: they meet one
    threshold a source.  Only rows equal to the threshold in every column can be
    on both sides of it; one such row is taken as often as the mix takes of them,
    so targets are met whatever ids repeat or lack.  Nulls, ties and empty tables
    as in ``mix_sources``; columns of any names and types pass.
    """
    rows = cut(mixed_rows(docs, size, quality, weights, share, cap, seed, id_col, source_col).select("_src", *ORDER, "times", "_epochs"))
    place = F.struct(*ORDER)
    limits = rows.groupBy("_src").agg(F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("times") > F.col("_epochs"), place)).alias("_limit"))
    again = rows.join(limits.select("_src", "_limit"), "_src").where(place == F.col("_limit"))
    again = again.groupBy("_src").agg(F.sum(F.col("times") - F.col("_epochs")).alias("_again"))
    limits = cut(limits.join(again, "_src", "left"))
    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key(source_col).alias("_src"), F.col(id_col).alias("_id"),
                       document_key(id_col, quality, seed).alias("_key"), size.alias("size"), whole_row(docs).alias("_tie")).join(limits, "_src")
    more = F.coalesce((F.col("size") > 0) & (place < F.col("_limit")), F.lit(False)).cast("long")
    main = held.select("_row", (F.col("_epochs") + more).alias("_n"))
    # the key follows from the id and the text, so it need not be computed again
    same = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key(source_col).alias("_src"), F.col(id_col).alias("_id"),
                       whole_row(docs).alias("_tie")).join(limits, "_src")
    same = same.where(F.col("_id").eqNullSafe(F.col("_limit._id")) & (F.col("_tie") == F.col("_limit._tie")))
    extra = same.groupBy("_src").agg(F.first("_row").alias("_row"), F.first("_again").alias("_n")).select("_row", "_n")
    taken = main.unionByName(extra).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
