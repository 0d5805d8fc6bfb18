"""Id pools without state: allocation, freeing, reserving and giving out again as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import Tables


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... over the whole table; range partitions are counted first, so no task sees all rows."""
    t = Tables(rows.sparkSession)
    placed = t.keep(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_pid").orderBy(*order)
    return placed.withColumn("_at", F.row_number().over(w)).join(F.broadcast(counts), "_pid").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_pid", "_at", "_before")


def allocate(rows: DataFrame, pool: Sequence[str], order: Sequence[Column | str], bits: int, *, start: int = 1, free: DataFrame | None = None,
             strict: bool = False) -> DataFrame:
    """Adds ``id``: start, start + 1, ... in each pool by a total order; 0 (``strict``: an error) once 2^bits - 1 is passed.

    ``free``: (pool, lo, hi) ranges of freed ids (see ``free_ranges``), which are
    given out again, smallest first, before new ones.
    """
    pool = list(pool)
    out = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*pool).orderBy(*order)))
    again = F.lit(None).cast("long")
    if free is not None:
        upto = Window.partitionBy(*pool).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
        ranges = free.select(*pool, "lo", F.sum(F.col("hi") - F.col("lo") + 1).over(upto).alias("_end"), (F.col("hi") - F.col("lo") + 1).alias("_len"))
        total = free.groupBy(*pool).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_freed"))
        ranges = ranges.select(*pool, "lo", "_end", (F.col("_end") - F.col("_len")).alias("_begin"))
        out = out.join(total, pool, "left").withColumn("_freed", F.coalesce("_freed", F.lit(0)))
        out = out.alias("r").join(ranges.alias("f"), [*[F.col(f"r.{c}") == F.col(f"f.{c}") for c in pool], F.col("_nth") > F.col("_begin"), F.col("_nth") <= F.col("_end")], "left")
        out = out.select("r.*", (F.col("lo") + F.col("_nth") - F.col("_begin") - 1).alias("_again"))
        again = F.col("_again")
    n = F.col("_nth") - (F.col("_freed") if free is not None else 0) + (start - 1)
    over = F.raise_error(F.lit(f"a pool of {bits} bits is used up")).cast("long") if strict else F.lit(0)
    return out.withColumn("id", F.coalesce(again, F.when(n < 1 << bits, n).otherwise(over)).cast("long")).drop("_nth", "_freed", "_again")


def free_ranges(ids: DataFrame, pool: Sequence[str], value: str) -> DataFrame:
    """Freed ids as maximal ranges (lo, hi): neighbours are merged."""
    w = Window.partitionBy(*pool).orderBy(value)
    d = ids.select(*pool, value).distinct()
    d = d.withColumn("_new", (F.col(value) != F.lag(value).over(w) + 1).cast("int"))
    d = d.withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*pool, "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_island")


def reserve(ranges: DataFrame, taken: DataFrame, pool: Sequence[str], value: str) -> DataFrame:
    """Free ranges without the taken ids: each range splits at them.

    Starts of ranges and taken ids lie on one line a pool; each begins a piece that
    ends before the next of them, or with the range.  Nothing is compared with more than its neighbours.
    """
    pool = list(pool)
    starts = ranges.select(*pool, F.col("lo").alias("_at"), F.lit(0).alias("_taken"), F.col("hi").alias("_hi"))
    events = starts.unionByName(taken.select(*pool, F.col(value).alias("_at"), F.lit(1).alias("_taken")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(*pool).orderBy("_at", "_taken")
    hi = F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pieces = events.select(*pool, (F.col("_at") + F.col("_taken")).alias("lo"), F.least(hi, F.lead("_at").over(w) - 1).alias("hi"))
    return pieces.where("lo <= hi")


def register_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """One id a full path, with directory and name."""
    d = paths.select(path).where(F.col(path).isNotNull()).distinct()
    return numbered(d, [path], "id").select(
        F.col("id").alias("file_id"), path, F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("directory"), F.element_at(F.split(path, "/"), -1).alias("name"))
