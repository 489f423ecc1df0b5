"""Sitemaps: locations of url sets and indexes, leniently; expansion of indexes over a table of stored files."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.sources.shared import saved

MOST_BYTES = 2 << 20
_LOC = re.compile(r"<(?:[A-Za-z0-9_]+:)?loc\b[^>]*>(.*?)</(?:[A-Za-z0-9_]+:)?loc\s*>", re.S)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def locations(xml: str | None) -> list[str]:
    """``loc`` values of a urlset or a sitemapindex, with or without a namespace; none for anything else."""
    raw = (xml or "").encode("utf-8", "surrogatepass")[:MOST_BYTES]
    text = _COMMENT.sub("", raw.decode("utf-8", "ignore"))
    if not re.search(r"<(?:[A-Za-z0-9_]+:)?(?:urlset|sitemapindex)\b", text):
        return []
    out = []
    for raw in _LOC.findall(text):
        cdata = _CDATA.fullmatch(raw.strip())
        value = cdata[1] if cdata else unescape(raw)
        if value.strip():
            out.append(value.strip())
    return out


def sitemap_urls(files: DataFrame) -> DataFrame:
    """files (url, xml) -> (source, ord, loc)."""

    def run(batches):
        for batch in batches:
            rows = [(u, i, x) for u, t in zip(batch.column("url").to_pylist(), batch.column("xml").to_pylist(), strict=True) for i, x in enumerate(locations(t))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["source", "ord", "loc"])

    return files.select("url", "xml").mapInArrow(run, "source string, ord int, loc string")


def expand(files: DataFrame, start: DataFrame) -> DataFrame:
    """(loc): page locations reachable from ``start`` (url) through stored sitemaps; a ``.xml`` location is one more sitemap.

    Each sitemap is visited once, and the search ends where no new one turns up, however deep the indexes nest.
    """
    listed = saved(sitemap_urls(files), "sitemap")
    seen = saved(start.select("url").distinct(), "sitemap-seen")
    frontier, out = seen, None
    while True:
        found = listed.join(frontier, listed["source"] == frontier["url"]).select("loc").distinct()
        pages = found.filter(~F.endswith(F.lower("loc"), F.lit(".xml")))
        out = pages if out is None else out.unionByName(pages)
        fresh = saved(found.filter(F.endswith(F.lower("loc"), F.lit(".xml"))).select(F.col("loc").alias("url")).join(seen, "url", "left_anti"), "sitemap-next")
        if not fresh.head(1):
            break
        seen, frontier = saved(seen.unionByName(fresh), "sitemap-seen"), fresh
    return out.distinct()


def expand_many(files: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (seed, url) -> (seed, loc): as :func:`expand`, for many sites at once; each site visits a sitemap once."""
    listed = saved(sitemap_urls(files), "sitemap")
    seen = saved(starts.select("seed", "url").distinct(), "sitemap-seen")
    frontier, out = seen, None
    while True:
        found = listed.join(frontier, listed["source"] == frontier["url"]).select("seed", "loc").distinct()
        is_map = F.endswith(F.lower("loc"), F.lit(".xml"))
        pages = found.filter(~is_map)
        out = pages if out is None else out.unionByName(pages)
        fresh = saved(found.filter(is_map).select("seed", F.col("loc").alias("url")).join(seen, ["seed", "url"], "left_anti"), "sitemap-next")
        if not fresh.head(1):
            return out.distinct()
        seen, frontier = saved(seen.unionByName(fresh), "sitemap-seen"), fresh
