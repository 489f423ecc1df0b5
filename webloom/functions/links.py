"""Links and images of a page: regular-expression generators (JVM-side) and the absolute URLs they stand for."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import bound, col
from webloom.functions.html_text import unescape_entities
from webloom.functions.url import CONTROL, is_excluded_scheme, origin, parts, resolve, resolved_parts


def raw_hrefs(html: Column | str) -> Column:
    """Trimmed, decoded href values of anchors in page order, none empty."""
    found = F.transform(F.regexp_extract_all(col(html), F.lit(fixed.ANCHOR_HREF), F.lit(1)), lambda h: unescape_entities(F.trim(h)))
    return F.filter(found, lambda h: h != "")


def raw_images(html: Column | str) -> Column:
    found = F.transform(F.regexp_extract_all(col(html), F.lit(fixed.IMAGE_SRC), F.lit(1)), lambda h: unescape_entities(F.trim(h)))
    return F.filter(found, lambda h: (h != "") & ~h.rlike("^(?:data:|blob:)"))


def bare_urls(html: Column | str) -> Column:
    """URLs anywhere in the text of a page, markup included: http forms first, then www forms."""
    http = F.regexp_extract_all(col(html), F.lit(fixed.HTTP_URL), F.lit(0))
    www = F.transform(F.regexp_extract_all(col(html), F.lit(fixed.WWW_URL), F.lit(0)), lambda w: F.concat(F.lit("https://"), w))
    return F.concat(http, www)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, raw): one row an anchor, excluded schemes left out."""
    rows = pages.select("page_id", "url", F.posexplode(raw_hrefs("html")).alias("ord", "raw"))
    return rows.filter(~is_excluded_scheme("raw"))


def rooted_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, abs_url) of root-relative hrefs, kept once a page at their first place; JVM-side only."""
    rows = anchors(pages).filter("raw LIKE '/%' AND raw NOT LIKE '//%'")
    rows = rows.select("page_id", "ord", F.concat(origin("url"), "raw").alias("abs_url"))
    return keep_first(rows, ["page_id", "abs_url"], "ord")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


_HREF, _SRC = re.compile(fixed.ANCHOR_HREF), re.compile(fixed.IMAGE_SRC)
_HTTP, _WWW = re.compile(fixed.HTTP_URL), re.compile(fixed.WWW_URL)
_EXCLUDED = re.compile(fixed.EXCLUDED_SCHEME)


def _decoded(x: str) -> str:
    x = x.strip()
    for a, b in fixed.ENTITIES:
        x = x.replace(a, b)
    return x


def page_links(html: str, url: str) -> list[str]:
    """Absolute links in order of first appearance: anchors, then bare URLs."""
    hrefs = [h for h in map(_decoded, _HREF.findall(html)) if h]
    texts = _HTTP.findall(html) + ["https://" + w for w in _WWW.findall(html)]
    found = (resolve(url, h) for h in hrefs + texts if not _EXCLUDED.match(h))
    return list(dict.fromkeys(x for x in found if x))


def page_images(html: str, url: str) -> list[str]:
    sources = (s for s in map(_decoded, _SRC.findall(html)) if s and not s.startswith(("data:", "blob:")))
    return list(dict.fromkeys(x for x in (resolve(url, s) for s in sources) if x))


def _trimmed(found: Column) -> Column:
    """Values without white space at their ends, decoded, none empty."""
    return F.filter(F.transform(found, lambda h: unescape_entities(F.regexp_replace(h, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))), lambda h: h != "")


def _resolved_once(references: Column, base: Column | str) -> Column:
    readable = F.filter(references, lambda h: ~h.rlike(CONTROL))
    found = bound(parts(F.coalesce(col(base), F.lit(""))), lambda b: F.transform(F.transform(readable, parts), lambda h: resolved_parts(b, h)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def absolute_links(pages: DataFrame) -> DataFrame:
    """(page_id, links, image_links): arrays of absolute URLs in order of first appearance, anchors before bare URLs; JVM-side,
    a page at a time without a shuffle. The same as :func:`page_links` and :func:`page_images`; null texts have none."""
    html = F.coalesce("html", F.lit(""))
    hrefs = _trimmed(F.regexp_extract_all(html, F.lit(fixed.ANCHOR_HREF), F.lit(1)))
    sources = _trimmed(F.regexp_extract_all(html, F.lit(fixed.IMAGE_SRC), F.lit(1)))
    wanted = F.filter(F.concat(hrefs, bare_urls(html)), lambda h: ~is_excluded_scheme(h))
    shown = F.filter(sources, lambda h: ~h.rlike("^(?:data:|blob:)"))
    return pages.select("page_id", _resolved_once(wanted, "url").alias("links"), _resolved_once(shown, "url").alias("image_links"))
