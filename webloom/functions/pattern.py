"""Patterns over URLs: exact, ``*`` wildcards, ``~`` regular expressions, ``~*`` regardless of case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import any_of, col


def compiled(pattern: str) -> tuple[str, str]:
    """(kind, value): exact (lower-cased text) or regex (portable pattern). ValueError for a pattern that isn't valid."""
    p = pattern.strip()
    if not p:
        raise ValueError("empty pattern")
    if p.startswith("~*"):
        kind, value = "regex", "(?i)" + p[2:].strip()
    elif p.startswith("~"):
        kind, value = "regex", p[1:].strip()
    elif "*" in p:
        kind, value = "regex", "(?is)^" + ".*".join(map(escape, p.split("*"))) + "$"
    else:
        return "exact", p.lower()
    try:
        re.compile(value)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return kind, value


def escape(text: str) -> str:
    """Backslashes before what is special in both dialects."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


def matches(x: Column | str, pattern: str) -> Column:
    kind, value = compiled(pattern)
    return F.lower(col(x)) == value if kind == "exact" else col(x).rlike(value)


def valid(patterns) -> list[str]:
    out = []
    for p in patterns:
        try:
            compiled(p)
        except ValueError:
            continue
        out.append(p.strip())
    return out


def is_blocked(url: Column | str, custom: tuple[str, ...] = ()) -> Column:
    """Whether one of the global or custom patterns matches; patterns that aren't valid are dropped."""
    return any_of(matches(url, p) for p in valid((*fixed.BLOCKED_PATTERNS, *custom)))


def is_resource_blocked(kind: Column | str, blocked: tuple[str, ...]) -> Column:
    return col(kind).isin(*blocked) if blocked else F.lit(False)
