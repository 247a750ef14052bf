"""Multiset algebra on arrays and equality of results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value), the value worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    once = F.array_distinct(a)
    many = F.transform(once, lambda x: F.least(F.size(F.filter(a, lambda y: y.eqNullSafe(x))), F.size(F.filter(b, lambda y: y.eqNullSafe(x)))))
    return F.aggregate(many, F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cell(value: Column) -> Column:
    """A result cell for comparing: numbers, also in strings, to 10 places; other strings trimmed; null stays apart."""
    number = value.try_cast("double")
    rounded = F.round(number, 10)
    shown = F.when(rounded == F.floor(rounded), F.format_string("%.0f", rounded)).otherwise(rounded.cast("string"))
    return F.when(value.isNull(), F.lit("∅")).otherwise(F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15), F.concat(F.lit("n:"), shown)).otherwise(F.concat(F.lit("s:"), F.trim(value))))
