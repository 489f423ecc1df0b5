"""Small column helpers used by all function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def contains_any(x: Column, needles: Iterable[str]) -> Column:
    return any_of(F.contains(x, F.lit(n)) for n in needles)


def first_bytes(x: Column, n: int) -> Column:
    """The first n bytes of a text, as text: a character that the limit cuts is left out."""
    short = F.octet_length(x) <= n
    cut = F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, n).cast("string"))
    return F.when(short, x).otherwise(F.rtrim(cut, F.lit("\ufffd")))


def replaced(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(by))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, so that steps built on steps stay small as expressions."""
    return F.element_at(F.transform(F.array(value), use), 1)
