"""Fill-in-middle: documents cut at two seeded unit ranks and rearranged round sentinels, over ropes.

A text is a rope: a balanced tree whose leaves are stretches of ``LEAF_UNITS`` units, and whose nodes cache the number of
units, of code points and of sentinels below them. The two cuts split the tree by unit rank (only the leaves that hold a cut are
read), the parts are joined in the form's order with sentinel leaves between, and the text is read off the leaves once. To restore, the
output's rope is split at its sentinels, by the cached numbers of sentinels, and the parts are joined in their first order.

Units: ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. With h1 to h4 from the sha256 of ``seed:doc_id``, the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A form is ``plain`` where the text is empty or
holds a sentinel, or h3 % 100 >= ``rate``; else ``spm`` where h4 % 100 < ``spm_rate``, else ``psm``. A sentinel begins with ``<``, ends with ``>`` and has none inside, so that text
beside it can't make up another one.

Edge cases: a null text is an empty one (plain, n = 0); a text of white space is one unit; very long texts are cut whole; a null id hashes
as an empty one; rows repeated give equal rows; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core

SENTINELS = ("<P>", "<S>", "<M>")
LEAF_UNITS = 256
_UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]+")
_STRETCH = re.compile(rf"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{1,{LEAF_UNITS}}}+|[\x20\x09-\x0D]+")
#: Output order of (prefix, suffix, middle), each behind its own sentinel.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


@dataclass(frozen=True, slots=True)
class Leaf:
    """A stretch source[start:end]; ``marks`` is 1 for a sentinel."""

    source: str
    start: int
    end: int
    units: int
    marks: int = 0

    @property
    def chars(self) -> int:
        return self.end - self.start


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int
    marks: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0, 0)


def joined(left: Rope, right: Rope) -> Rope:
    if not left.chars or not right.chars:
        return left if left.chars else right
    return Node(left, right, left.units + right.units, left.chars + right.chars, left.marks + right.marks)


def balanced(leaves: list[Rope]) -> Rope:
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def leaves_of(text: str, start: int = 0, end: int | None = None) -> list[Rope]:
    """The leaves of text[start:end], cut between units."""
    found = [Leaf(text, *m.span(), LEAF_UNITS) for m in _STRETCH.finditer(text, start, len(text) if end is None else end)]
    # All are full but the last stretch of words and white space behind it.
    for i in range(max(0, len(found) - 2), len(found)):
        x = found[i]
        found[i] = Leaf(text, x.start, x.end, sum(1 for _ in _UNIT.finditer(text, x.start, x.end)))
    return found


def split(rope: Rope, units: int) -> tuple[Rope, Rope]:
    """The rope's first ``units`` units, and the rest."""
    if units <= 0:
        return EMPTY, rope
    if units >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        for k, m in enumerate(_UNIT.finditer(rope.source, rope.start, rope.end), 1):
            if k == units:
                return Leaf(rope.source, rope.start, m.end(), units), Leaf(rope.source, m.end(), rope.end, rope.units - units)
    if units < rope.left.units:
        a, b = split(rope.left, units)
        return a, joined(b, rope.right)
    a, b = split(rope.right, units - rope.left.units)
    return joined(rope.left, a), b


def split_at_mark(rope: Rope) -> tuple[Rope, Rope]:
    """What lies before the first sentinel and what behind it."""
    if isinstance(rope, Leaf):
        return EMPTY, EMPTY
    if rope.left.marks:
        a, b = split_at_mark(rope.left)
        return a, joined(b, rope.right)
    a, b = split_at_mark(rope.right)
    return joined(rope.left, a), b


def text_of(rope: Rope) -> str:
    """The leaves' text; runs of neighbouring stretches of one source are read at once."""
    parts, stack = [], [rope]
    last: list | None = None
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            stack += (x.right, x.left)
        elif last and last[0] is x.source and last[2] == x.start:
            last[2] = x.end
        else:
            last = [x.source, x.start, x.end]
            parts.append(last)
    return "".join(s[a:b] for s, a, b in parts)


def rearranged(text: str, h: tuple[int, int, int, int], rate: int, spm_rate: int, sentinels: tuple[str, ...]) -> tuple:
    """(n, form, prefix's and middle's code points, output)."""
    rope = balanced(leaves_of(text))
    n = rope.units
    if not text or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    parts = (prefix, suffix, middle)
    out = EMPTY
    for k in ORDERS[form]:
        out = joined(joined(out, Leaf(sentinels[k], 0, len(sentinels[k]), 0, 1)), parts[k])
    return n, form, prefix.chars, middle.chars, text_of(out)


def restored(output: str, form: str, sentinels: tuple[str, ...]) -> str:
    """The text that :func:`rearranged` was given."""
    if form == "plain":
        return output
    leaves, at = [], 0
    for k in ORDERS[form]:
        mark = output.index(sentinels[k], at)
        leaves += leaves_of(output, at, mark)
        at = mark + len(sentinels[k])
        leaves.append(Leaf(output, mark, at, 0, 1))
    rest = balanced(leaves + leaves_of(output, at))
    _, rest = split_at_mark(rest)
    one, rest = split_at_mark(rest)
    two, three = split_at_mark(rest)
    parts = dict(zip(ORDERS[form], (one, two, three)))
    return text_of(joined(joined(parts[0], parts[2]), parts[1]))


def _checked(sentinels: tuple[str, ...]) -> tuple[str, ...]:
    if len(set(sentinels)) != 3 or not all(re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("three different sentinels are needed, each of the form <...>")
    return sentinels


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    _checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = core(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *hashes)

    def run(batch: pa.RecordBatch) -> dict:
        h = zip(*(batch.column(f"h{i}").to_pylist() for i in range(1, 5)))
        found = [rearranged(t.as_py(), x, rate, spm_rate, sentinels) for t, x in zip(batch.column("text"), h)]
        return {"doc_id": batch.column("doc_id")} | {c: [r[i] for r in found] for i, c in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    return arrow_map(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``rows`` (the result of :func:`fill_in_middle`) with ``restored``, rebuilt from output and form alone."""
    _checked(sentinels)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batch: pa.RecordBatch) -> dict:
        back = [restored(t.as_py(), f.as_py(), sentinels) for t, f in zip(batch.column("output"), batch.column("form"))]
        return {c: batch.column(c) for c in names} | {"restored": back}

    return arrow_map(core(rows, *names), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


__all__ = ["SENTINELS", "fill_in_middle", "restore"]
