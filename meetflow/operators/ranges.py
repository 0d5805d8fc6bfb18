"""The range lattice.  A missing row (or null bound) is top, the empty range; bottom is a kind's full range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_top(lo: Column, hi: Column) -> Column:
    return lo.isNull() | hi.isNull() | (lo > hi)


def is_bottom(lo: Column, hi: Column, full_lo: Column, full_hi: Column) -> Column:
    return ~is_top(lo, hi) & (lo <= full_lo) & (hi >= full_hi)


def weaker(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Whether a is at least as approximate as b: a contains b.  Top is contained in all."""
    return F.when(is_top(blo, bhi), True).when(is_top(alo, ahi), False).otherwise((alo <= blo) & (ahi >= bhi))


def equal(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return (is_top(alo, ahi) & is_top(blo, bhi)) | (alo.eqNullSafe(blo) & ahi.eqNullSafe(bhi))


def meet(alo: Column, ahi: Column, blo: Column, bhi: Column) -> tuple[Column, Column]:
    """The hull; least and greatest skip nulls, so top is neutral."""
    a, b = ~is_top(alo, ahi), ~is_top(blo, bhi)
    return F.least(F.when(a, alo), F.when(b, blo)), F.greatest(F.when(a, ahi), F.when(b, bhi))


def meet_all(lo: str, hi: str) -> list[Column]:
    """The hull of a group."""
    return [F.min(lo).alias(lo), F.max(hi).alias(hi)]


def join(alo: Column, ahi: Column, blo: Column, bhi: Column) -> tuple[Column, Column]:
    """The intersection; null bounds where it is empty."""
    lo, hi = F.greatest(alo, blo), F.least(ahi, bhi)
    some = ~is_top(alo, ahi) & ~is_top(blo, bhi) & (lo <= hi)
    return F.when(some, lo), F.when(some, hi)


def text(lo: Column, hi: Column, full_lo: Column | None = None, full_hi: Column | None = None) -> Column:
    """``[lo, hi]``; nil_Top for the empty range, Bot for a kind's full range if its bounds are given."""
    out = F.when(is_top(lo, hi), "nil_Top")
    if full_lo is not None:
        out = out.when(is_bottom(lo, hi, full_lo, full_hi), "Bot")
    return out.otherwise(F.concat(F.lit("["), lo.cast("string"), F.lit(", "), hi.cast("string"), F.lit("]")))


def of_kind(akind: Column, bkind: Column, value: Column) -> Column:
    """A value from two ranges of one kind; raises where the kinds differ."""
    return F.when(akind.eqNullSafe(bkind), value).otherwise(
        F.raise_error(F.format_string("ranges of kinds %s and %s", akind.cast("string"), bkind.cast("string"))).cast("long"))


def widen(alo: Column, ahi: Column, blo: Column, bhi: Column, full_lo: Column, full_hi: Column) -> tuple[Column, Column]:
    """The full range where b contains a and more, else the hull; equal ranges stay."""
    grew = ~is_top(alo, ahi) & weaker(blo, bhi, alo, ahi) & ~equal(alo, ahi, blo, bhi)
    lo, hi = meet(alo, ahi, blo, bhi)
    return F.when(grew, full_lo).otherwise(lo), F.when(grew, full_hi).otherwise(hi)
