"""Sets of ids as rows of 64-bit words, for sets too large or too many for lists.

A set is the rows (keys, ``word``, ``bits``) of one key: bit i of word w says that
64 * w + i is in it (negative ids, too).  Meets are ``bit_or`` and ``bit_and``
aggregates with partial sums before the shuffle, so a shuffle moves words, not
elements, and no set meets in one row or task.  Words without bits aren't stored:
a key without rows is the empty set.  Null ids and repeated rows add nothing;
empty tables are empty sets; a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(rows: DataFrame, keys: Sequence[str], element: str) -> DataFrame:
    """Words of the sets whose elements are rows (keys, element)."""
    at = rows.where(F.col(element).isNotNull()).select(*keys, F.col(element).cast("long").alias("_e"))
    bit = F.expr("shiftleft(1L, cast(_e & 63 as int))")
    return at.groupBy(*keys, F.shiftright("_e", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpack(words: DataFrame, keys: Sequence[str], element: str) -> DataFrame:
    """A row an element."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return words.select(*keys, "word", F.explode(places).alias("_i")).select(*keys, (F.col("word") * 64 + F.col("_i")).alias(element))


def meet_all(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of all sets that share ``keys``, whatever other columns told them apart."""
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return meet_all(a.select(*keys, "word", "bits").unionByName(b.select(*keys, "word", "bits")), keys)


def _beside(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    names = [*keys, "word"]
    other = b.select(*[F.col(c).alias(f"_b_{c}") for c in names], F.col("bits").alias("_bits"))
    same = None
    for c in names:
        ok = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        same = ok if same is None else same & ok
    return a.select(*names, "bits").join(other, same, how)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = _beside(a, b, keys, "inner").select(*keys, "word", F.col("bits").bitwiseAND(F.col("_bits")).alias("bits"))
    return both.where("bits <> 0")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_bits", F.lit(0).cast("long"))))
    return _beside(a, b, keys, "left").select(*keys, "word", rest.alias("bits")).where("bits <> 0")


def lengths(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) for sets that aren't empty."""
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("n"))


def not_within(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose set in ``a`` has an element that theirs in ``b`` lacks; for all others a is a subset."""
    return difference(a, b, keys).select(*keys).distinct()
