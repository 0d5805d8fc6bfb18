"""Structured Streaming over program tables: only changed functions are analysed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, fn: Sequence[str], version: str) -> DataFrame:
    """Rows of each function's newest version."""
    newest = rows.groupBy(*fn).agg(F.max(version).alias(version))
    return rows.join(newest, [*fn, version], "left_semi")


def analyse_stream(rows: DataFrame, fn: Sequence[str], version: str, analyse: Callable[[DataFrame], DataFrame], target: str,
                   checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``analyse`` on the functions of each micro-batch and appends their facts to ``target``.

    ``rows`` is a streaming DataFrame of instruction rows; all rows of a function's
    version come in one batch.  Facts carry the version and the batch, so
    ``current`` picks each function's last result; functions are independent, so
    no state but the tables is kept.  The versions analysed go to ``target`` with
    ``-versions`` behind it, so a version without facts counts, too.  A batch that
    is run again overwrites its own folders (exactly once).
    """

    def batch(df: DataFrame, number: int) -> None:
        new = latest(df, fn, version)
        versions = new.select(*fn, version).distinct().withColumn("batch", F.lit(number).cast("long"))
        versions.write.mode("overwrite").parquet(f"{target}-versions/number={number}")
        versions = versions.drop("batch")
        facts = analyse(new.drop(version)).join(versions, list(fn))
        facts.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/number={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(facts: DataFrame, fn: Sequence[str], version: str, versions: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The facts of each function's newest version, from the last batch that had it.

    ``versions``: (fn, version, batch), all that were analysed; a newest version
    without facts leaves the function without any.  ``gone``: (fn) of functions
    that were deleted.
    """
    fn = list(fn)
    newest = versions.groupBy(*fn).agg(F.max(F.struct(version, "batch")).alias("_m")).select(*fn, F.col(f"_m.{version}").alias(version), F.col("_m.batch").alias("batch"))
    if gone is not None:
        newest = newest.join(gone.select(*fn), fn, "left_anti")
    return facts.join(newest, [*fn, version, "batch"], "left_semi")


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and key with a watermark: how many functions of each kind arrive."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks want instants
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), *keys, "n")
