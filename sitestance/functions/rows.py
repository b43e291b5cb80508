"""Arrays to rows without a pushed-down size filter.

A plain ``explode`` makes the optimizer add a filter on the array's size and push it
below the projections that build the array, which evaluates them a second time.
The outer forms plus a filter on the exploded value do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, carry: list, array, name: str) -> DataFrame:
    """``(…carry, name)``, one row per element."""
    return df.select(*carry, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def numbered(df: DataFrame, carry: list, array, pos: str, name: str) -> DataFrame:
    """``(…carry, pos, name)``, positions from zero."""
    return df.select(*carry, F.posexplode_outer(array).alias(pos, name)).where(
        F.col(pos).isNotNull()
    )


def inlined(df: DataFrame, carry: list, structs, marker: str) -> DataFrame:
    """Struct fields as columns; ``marker`` is a field that is never NULL."""
    return df.select(*carry, F.inline_outer(structs)).where(F.col(marker).isNotNull())


def map_rows(df: DataFrame, carry: list, mapped: Column | str, key: str, value: str) -> DataFrame:
    """One row per map entry."""
    return df.select(*carry, F.explode_outer(mapped).alias(key, value)).where(
        F.col(key).isNotNull()
    )


def multimap(entries: Column) -> Column:
    """``(key, value)`` entries to a map; the values of a repeated key are put together."""

    def values(found: Column, key: Column) -> Column:
        own = F.filter(found, lambda e: e["key"] == key)
        return F.flatten(F.transform(own, lambda e: e["value"]))

    def build(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda e: e["key"]))
        joined = F.transform(keys, lambda k: F.struct(k.alias("key"), values(found, k).alias("value")))
        return F.map_from_entries(F.when(F.size(keys) == F.size(found), found).otherwise(joined))

    return F.element_at(F.transform(F.array(entries), build), 1)


def overlaid(*maps: Column) -> Column:
    """One map of all entries; of entries with one key the last map's counts."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), maps)
