"""Column helpers for the operators that stay with built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.llm.common import WHITE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    none = F.array().cast("array<string>")
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) == 0, none).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches, in code points from 0.

    The text between matches comes from split, so a match starts where the lengths before it end.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), stop.alias("e"), x["m"].alias("m"))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
