"""Vector clocks as map<string,bigint>; a missing entry counts as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("bigint"))


def merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(_zero(x), _zero(y)))


def bump(clock: Column, author: Column) -> Column:
    return F.map_concat(F.map_filter(clock, lambda k, _: k != author), F.map_from_arrays(F.array(author), F.array(_zero(F.try_element_at(clock, author)) + 1)))


def _any(a: Column, b: Column, test) -> Column:
    return F.exists(F.map_values(F.map_zip_with(a, b, lambda _, x, y: test(_zero(x), _zero(y)))), lambda v: v)


def equal(a: Column, b: Column) -> Column:
    return ~_any(a, b, lambda x, y: x != y)


def dominates(a: Column, b: Column) -> Column:
    """a is nowhere behind b, and somewhere ahead."""
    return ~_any(a, b, lambda x, y: x < y) & _any(a, b, lambda x, y: x > y)


def concurrent(a: Column, b: Column) -> Column:
    return _any(a, b, lambda x, y: x < y) & _any(a, b, lambda x, y: x > y)
