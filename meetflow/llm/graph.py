"""Connected components and streamed groups, shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import remove, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(v, comp) for every node of an edge; comp is one of the component's nodes, the same for all.

    Each round hangs every node on its smallest neighbour (or itself), goes up two
    steps, and replaces the ends of every edge by what they hang on: edges inside
    a tree vanish, the rest are made distinct, so tables shrink quickly and chains
    halve.  Rounds end when no edge is left.  All state is in tables of the shared
    folder, and the driver sees one number a round.
    """
    spark = edges.sparkSession
    e, e_path = stored(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("w")).where("v < w").distinct())
    label, label_path = stored(e.select("v").union(e.select("w")).distinct().select("v", F.col("v").alias("comp")))
    for _ in range(most_rounds):
        if not e.limit(1).count():
            remove(spark, e_path)
            return label
        low = e.groupBy(F.col("w").alias("x")).agg(F.min("v").alias("m"))
        high = e.select(F.col("v").alias("x"), F.col("v").alias("m"))
        up, up_path = stored(low.unionByName(high).groupBy("x").agg(F.min("m").alias("m")))
        once = up.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        twice, twice_path = stored(up.join(once, "m").select("x", F.col("mm").alias("m")))
        top = twice.join(twice.select(F.col("x").alias("m"), F.col("m").alias("mm")), "m").select("x", F.col("mm").alias("m"))
        top, top_path = stored(top)
        moved = e.join(top.select(F.col("x").alias("v"), F.col("m").alias("a")), "v").join(top.select(F.col("x").alias("w"), F.col("m").alias("b")), "w")
        new_e, new_e_path = stored(moved.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("w")).where("v < w").distinct())
        new_label, new_label_path = stored(label.join(top.select(F.col("x").alias("comp"), F.col("m")), "comp", "left").select("v", F.coalesce("m", "comp").alias("comp")))
        remove(spark, e_path, label_path, up_path, twice_path, top_path)
        e, e_path, label, label_path = new_e, new_e_path, new_label, new_label_path
    raise RuntimeError(f"components: edges left after {most_rounds} rounds")


def groups(batches, keys: list[str]):
    """Tables of whole groups of a partition sorted by keys, and where each begins; several groups a table."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        change = starts(t, keys)
        last = int(change[-1])
        rest = t.slice(last)
        if last:
            yield t.slice(0, last), np.append(change[:-1], last)
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each node the smallest node of its component, from a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label, n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks(df: DataFrame, n_blocks: str, node: str, keys: list[str]) -> DataFrame:
    """Every row once for each pair of blocks (i, j) of its group that its own block is in; n_blocks is 1 for groups that fit."""
    own = df.withColumn("_own", F.pmod(F.xxhash64(F.lit(3), F.col(node)), F.col(n_blocks)).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1)))
    own = own.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_own", "_other")
    keys = [*keys, "_i", "_j"]
    return own.repartition(*keys).sortWithinPartitions(*keys)
