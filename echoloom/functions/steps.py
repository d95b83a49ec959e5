"""Step functions and lookups shared by the scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(col: Column, steps, otherwise) -> Column:
    """Value of the first step (highest bound first) that `col` reaches."""
    out = None
    for bound, value in steps:
        out = F.when(col >= bound, F.lit(value)) if out is None else out.when(col >= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def at_most(col: Column, steps, otherwise) -> Column:
    """Value of the first step (lowest bound first) that `col` does not pass."""
    out = None
    for bound, value in steps:
        out = F.when(col <= bound, F.lit(value)) if out is None else out.when(col <= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def below(col: Column, steps, otherwise) -> Column:
    """Value of the first step (lowest bound first) that `col` stays under."""
    out = None
    for bound, value in steps:
        out = F.when(col < bound, F.lit(value)) if out is None else out.when(col < bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def lookup(col: Column, table: dict, otherwise) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def first_contained(col: Column, rules, otherwise) -> Column:
    """Name of the first rule one of whose words is contained in `col`."""
    out = None
    for name, words in rules:
        hit = any_contained(col, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def any_contained(col: Column, words) -> Column:
    out = col.contains(words[0])
    for word in words[1:]:
        out = out | col.contains(word)
    return out


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def compact(*items: Column) -> Column:
    """Array of the items that are not NULL, order kept."""
    return F.array_compact(F.array(*items))
