"""The map lattice as rows (owner, key, value columns), two-point and pair lattices.

Top values are not stored: a missing key is top.  ``owner`` and ``key`` columns
are lists of names, so a map may belong to a node, a function and an analysis.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meet(a: DataFrame, b: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Keys of either side; the values of a key meet by the aggregates."""
    return a.unionByName(b).groupBy(*keys).agg(*aggs)


def join(a: DataFrame, b: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keys of both sides; ``combine`` gets the joined rows (b's values end in _b) and drops top results."""
    other = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return combine(a.join(other, list(keys)))


def widen(a: DataFrame, b: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keys of either side; ``combine`` gets the joined rows (b's values end in _b, null where a side lacks the key, which is top)."""
    other = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return combine(a.join(other, list(keys), "full"))


def set_strong(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values replace old ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def set_weak(old: DataFrame, new: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """New values meet the old ones; a key without an old value is top and takes the new."""
    return meet(old, new, keys, aggs)


def flatten(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The nearest definition of each key; the first layer is the nearest."""
    stacked = None
    for depth, layer in enumerate(layers):
        layer = layer.withColumn("_depth", F.lit(depth))
        stacked = layer if stacked is None else stacked.unionByName(layer)
    w = Window.partitionBy(*keys).orderBy("_depth")
    return stacked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_depth")


def get(layers: Sequence[DataFrame], keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Values of wanted keys through the layers; null where none has them."""
    return wanted.join(flatten(layers, keys), list(keys), "left")


def all_keys(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = layers[0].select(*keys)
    for layer in layers[1:]:
        out = out.unionByName(layer.select(*keys))
    return out.distinct()


def weaker(a: DataFrame, b: DataFrame, owner: Sequence[str], key: Sequence[str], test: Callable[[Column], Column]) -> DataFrame:
    """For each owner, whether a is at least as approximate as b on every key.

    ``test`` gets a function from column name to the joined column (b's end in _b).
    A key that a lacks is top there, which is weaker only than top.
    """
    other = b.select(*owner, *key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in (*owner, *key)], F.lit(True).alias("_in_b"))
    j = a.withColumn("_in_a", F.lit(True)).join(other, [*owner, *key], "full")
    ok = F.when(F.col("_in_b").isNull(), True).when(F.col("_in_a").isNull(), False).otherwise(test(F.col))
    return j.groupBy(*owner).agg(F.bool_and(ok).alias("weaker"))


def equal(a: DataFrame, b: DataFrame, owner: Sequence[str], key: Sequence[str]) -> DataFrame:
    values = [c for c in a.columns if c not in (*owner, *key)]
    other = b.select(*owner, *key, *[F.col(c).alias(f"{c}_b") for c in values], F.lit(True).alias("_in_b"))
    j = a.withColumn("_in_a", F.lit(True)).join(other, [*owner, *key], "full")
    ok = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    for c in values:
        ok = ok & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return j.groupBy(*owner).agg(F.bool_and(ok).alias("equal"))


def text(m: DataFrame, owner: Sequence[str], key: str, value: Column) -> DataFrame:
    """Each owner's map as ``{k: v, ...}`` sorted by key."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), value.alias("_v"))))
    shown = F.transform(pairs, lambda p: F.concat(p[key].cast("string"), F.lit(": "), F.coalesce(p["_v"].cast("string"), F.lit("nil_Top"))))
    return m.groupBy(*owner).agg(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("text"))


# two points: a boolean, true for bottom; missing rows are top

def point_meet(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def point_join(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


point_widen = point_meet


def point_weaker(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | ~F.coalesce(b, F.lit(False))


def point_meet_all(name: str) -> Column:
    return F.coalesce(F.bool_or(name), F.lit(False))


def pair(op: Callable[[Column, Column], Column], a_in: Column, a_out: Column, b_in: Column, b_out: Column) -> Column:
    """An operation on both sides of (in, out) pairs."""
    return F.struct(op(a_in, b_in).alias("in"), op(a_out, b_out).alias("out"))


def pair_update(facts: DataFrame, e: DataFrame, fn: Sequence[str], values: Sequence[str], aggs: Sequence[Column], *, backward: bool = False) -> DataFrame:
    """(fn, node, values): the IN of nodes from the OUT of those before them (``backward``: OUT from the IN of those after).

    ``facts``: (fn, node, point, values), ``e``: (fn, src, dst); several met by the aggregates.
    """
    fn, (near, far), point = list(fn), ("dst", "src") if backward else ("src", "dst"), "IN" if backward else "OUT"
    side = facts.where(F.col("point") == point).select(*fn, F.col("node").alias(near), *values)
    return e.select(*fn, "src", "dst").distinct().join(side, [*fn, near]).groupBy(*fn, F.col(far).alias("node")).agg(*aggs)


def scoped(m: DataFrame, scope: DataFrame, key: Sequence[str]) -> DataFrame:
    """The map without keys outside a scope."""
    return m.join(scope.select(*key).distinct(), list(key), "left_semi")


def with_default(m: DataFrame, wanted: DataFrame, keys: Sequence[str], default: dict) -> DataFrame:
    """Values of wanted keys, a default for those the map lacks."""
    return wanted.join(m, list(keys), "left").fillna(default)


def chained(local: Column, parent: Column) -> Column:
    """A local value over its parent's."""
    return F.coalesce(local, parent)


# sorted stores in one row: keys with values, each key once

def store_put(store: Column, key: Column, value: Column) -> Column:
    """A map column with a key added or overwritten."""
    return F.map_concat(F.map_filter(store, lambda k, v: k != key), F.create_map(key, value))


def store_remove(store: Column, key: Column) -> Column:
    return F.map_filter(store, lambda k, v: k != key)


def store_get(store: Column, key: Column) -> Column:
    return F.try_element_at(store, key)


def store_meet(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Keys of both stores; values of common keys combined, others as they are."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(combine(x, y)))
