"""Templates, array helpers, and loosely typed values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_first(template: str, value: Column) -> Column:
    """Every `{}` takes the same value; a value that holds `{}` itself is refused (null)."""
    return F.when(~F.contains(value.cast("string"), F.lit("{}")), F.replace(F.lit(template), F.lit("{}"), value.cast("string")))


def format_map(template: str, values: dict[str, Column]) -> Column:
    """`{name}` takes the value of that name; unknown names stay.  Values are not searched again."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template, re.ASCII):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), values[m[1]].cast("string")]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render(template: str, name: str, value: Column) -> Column:
    return format_map(template, {name: value})


def bump(value: Column, n: int) -> Column:
    """Numeric text plus n, as text; other text unchanged."""
    return F.coalesce((value.try_cast("bigint") + n).cast("string"), value)


def as_int(value: Column) -> Column:
    """Integer value of text or number; 0 where there is none."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def index_of(a: Column, x) -> Column:
    """0-based place of the first x, -1 without one."""
    return (F.array_position(a, x) - 1).cast("int")


def add_once(a: Column, x: Column) -> Column:
    return F.when(F.array_contains(a, x), a).otherwise(F.array_append(a, x))


def matching(a: Column, pattern: str) -> Column:
    return F.filter(a, lambda x: F.rlike(x, F.lit(pattern)))


def indexed_filter(a: Column, test) -> Column:
    """Keeps x where test(index, x)."""
    return F.filter(a, lambda x, i: test(i, x))


def indexed_map(a: Column, make) -> Column:
    return F.transform(a, lambda x, i: make(i, x))


def sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))
