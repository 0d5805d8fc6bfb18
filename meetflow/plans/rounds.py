"""Fixed points over DataFrames.

A round is one job over tables in the shared folder; the driver holds the loop
and one number a round.  Tables of finished rounds are removed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="meetflow-"))
    return sc.getCheckpointDir()


#: A table of up to so many rows is sent whole to a join's tasks.  Parquet packs sorted ids so tightly that Spark, which goes by
#: the size of files, would send tables of many million rows, which the driver has to hold.
FEW = 50_000
#: Known rows from here on are read, not shuffled, where few new ones are set apart from them.
MANY = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The table, with what joins may do with it by its count of rows."""
    return df.hint("broadcast" if rows <= FEW else "merge")


class Tables:
    """Tables of one computation, written once and removed when they are no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def __enter__(self) -> "Tables":
        return self

    def __exit__(self, *_) -> None:
        self.drop(self.top)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows as a table: what every round reads again is computed once."""
        return self.put(df)[0]

    def put(self, df: DataFrame, counted: str = "true") -> tuple[DataFrame, str, int]:
        """The table, its path and how many of its rows meet ``counted``, from one job."""
        path, seen = f"{self.top}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count_if(F.expr(counted)).alias("n"), F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return sized(self.spark.read.schema(df.schema).parquet(path), seen.get["rows"]), path, seen.get["n"]

    def read(self, schema, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, *paths: str) -> None:
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def lacking(rows: DataFrame, known: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows that aren't among ``known`` ones, nulls being equal."""
    k = known.select(*[F.col(c).alias(f"_k_{c}") for c in rows.columns])
    same = None
    for c in rows.columns:
        ok = rows[c].eqNullSafe(k[f"_k_{c}"])
        same = ok if same is None else same & ok
    return rows.join(k, same, how)


def put_new(t: Tables, rows: DataFrame, known: DataFrame, n_known: int, n_delta: int) -> tuple[DataFrame, str, int]:
    """Table of the distinct ``rows`` that ``known`` lacks.  Where few meet many, known rows are read once and only those that meet are joined."""
    if n_known <= MANY or n_delta > FEW:
        return t.put(lacking(rows, sized(known, n_known)))
    rows, path, n = t.put(rows)
    known = lacking(known, rows, "left_semi") if n <= FEW else sized(known, n_known)
    got = t.put(lacking(rows, known))
    t.drop(path)
    return got


#: Tables of known rows that are read together before they are joined into one.
PATHS = 12


#: Steps of one round of ``close_rows`` once chains prove long: rounds, and joins with known rows, are so many times fewer.
HOPS, SHORT_ROUNDS = 4, 6


def close_rows(seed: DataFrame, step: Callable[..., DataFrame], most_rounds: int = 10_000, *, known: DataFrame | None = None,
               with_known: bool = False) -> DataFrame:
    """Least set of rows that holds ``seed`` and is closed under ``step`` (semi-naive).

    ``step(delta)`` must distribute over union: it sees only the rows new in the last
    round.  Right for sets of facts, where meet is union.  After some rounds each
    takes several steps before new rows are set apart from known ones.  ``known``:
    rows that are closed already, to which ``seed`` adds.  For rules over two rows,
    ``with_known``: ``step(delta, known)`` joins new rows with all known ones, new
    ones included, one step a round.  Raises when ``most_rounds`` do not suffice; a
    partial result is never returned.
    """
    t = Tables(seed.sparkSession)
    names = seed.columns

    paths, total = [], 0
    if known is not None:
        known, path, total = t.put(known.select(*names))
        paths.append(path)
    first = seed.distinct()
    delta, path, n = t.put(lacking(first, known) if paths else first)
    paths.append(path)
    for done in range(most_rounds):
        if not n:
            return t.read(seed.schema, paths)
        total += n
        if len(paths) > PATHS:  # the last is delta, which is still read
            joined = t.put(t.read(seed.schema, paths[:-1]))[1]
            t.drop(*paths[:-1])
            paths = [joined, paths[-1]]
        also = [sized(t.read(seed.schema, paths), total)] if with_known else []
        cand = last = step(delta, *also).select(*names).distinct()
        few = total > MANY and n <= FEW  # a step is quick then, since nothing large moves
        for _ in range(HOPS - 1 if done >= SHORT_ROUNDS and not with_known and not few else 0):
            last = step(last).select(*names).distinct()
            cand = cand.unionByName(last)
        if last is not cand:
            cand = cand.distinct()
        delta, path, n = put_new(t, cand, t.read(seed.schema, paths), total, n)
        paths.append(path)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def close_values(seed: DataFrame, keys: Sequence[str], values: Sequence[str], meet: Sequence[Column],
                 step: Callable[[DataFrame, DataFrame], DataFrame], *, widen: Callable[[DataFrame], DataFrame] | None = None,
                 widen_after: int = 8, most_rounds: int = 10_000, replace: bool = False) -> DataFrame:
    """Fixed point of values per key.  A missing key is top.

    ``step(facts, changed)`` gives candidate rows (keys, values) for the keys
    that depend on ``changed`` (keys whose value moved in the last round); it may
    read all ``facts``, so transfers need not distribute over meet.  Candidates
    meet the old values by the aggregates ``meet``, in the same pass that compares
    them (``replace``: they take their place, candidates of one key met alone).  After ``widen_after`` rounds
    ``widen`` gets rows with values and their predecessors (``old_`` names, null
    if there were none) and returns the same columns with values widened.
    """
    t = Tables(seed.sparkSession)
    keys, values = list(keys), list(values)
    merged, path, moves = t.put(seed.groupBy(*keys).agg(*meet).select(*keys, *values, F.lit(True).alias("_moved")), "_moved")
    for n in range(most_rounds):
        facts = merged.select(*keys, *values)
        if not moves:
            return facts
        cand = step(facts, sized(merged.where("_moved").select(*keys), moves)).select(*keys, *values)
        old = facts.select("*", *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_had"))
        if replace:
            cand = cand.groupBy(*keys).agg(*meet)
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
            other = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"old_{v}" for v in values], "_had")
            fresh = cand.join(other, same, "left").select(*keys, *values, *[f"old_{v}" for v in values], "_had")
            gone = cand.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
            both = fresh.unionByName(old.join(gone, same, "left_anti"))
        else:
            rows = cand.unionByName(old, allowMissingColumns=True).groupBy(*keys)
            both = rows.agg(*meet, *[F.first(f"old_{v}", ignorenulls=True).alias(f"old_{v}") for v in values], F.max("_had").alias("_had"))
        if widen and n >= widen_after:
            both = widen(both)
        moved = F.col("_had").isNull()
        for v in values:
            moved = moved | ~F.col(v).eqNullSafe(F.col(f"old_{v}"))
        done = path
        merged, path, moves = t.put(both.select(*keys, *values, moved.alias("_moved")), "_moved")
        t.drop(done)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
