"""The public entry points over stored pages, links and hits: scrape, crawl, map, search, brand, evaluate.

Requests are checked here; what is checked then becomes one declarative plan. Fetching stays outside: pages come from
a table (page_id, url, html and, where known, status, content_type, raw).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.classify import fetch_route, fetch_warning, is_soft_failure, with_escalation
from webloom.functions.url import is_binary_path
from webloom.operators import crawl as crawling
from webloom.operators import extract, robots
from webloom.operators.evaluate import evaluate
from webloom.operators.search import search as search_hits

RENDER_MODES = ("", "auto", "http", "browser")


def parse_render_mode(mode: str | None) -> str:
    m = (mode or "").strip().lower()
    if m not in RENDER_MODES:
        raise ValueError(f"unknown render mode {mode!r}")
    return m


def _url(url: str) -> str:
    if not url.startswith(("http://", "https://")):
        raise ValueError("url must start with http:// or https://")
    return url


def _within(name: str, value: int | float | None, low: float, high: float) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must lie between {low:g} and {high:g}")


@dataclass(frozen=True)
class ScrapeRequest:
    formats: list[str] = field(default_factory=lambda: ["markdown"])
    extractor: str = "auto"
    include_tags: list[str] | None = None
    exclude_tags: list[str] | None = None
    css_selector: str | None = None
    render_mode: str = "auto"
    compat: bool = False

    def __post_init__(self) -> None:
        extract.parse_formats(self.formats)
        parse_render_mode(self.render_mode)
        if self.extractor not in extract.EXTRACTORS:
            raise ValueError(f"unknown extractor {self.extractor!r}")


@dataclass(frozen=True)
class CrawlRequest:
    url: str
    max_depth: int = 2
    max_pages: int = 100

    def __post_init__(self) -> None:
        _url(self.url)
        _within("max_depth", self.max_depth, 0, 100)
        _within("max_pages", self.max_pages, 1, 100)


@dataclass(frozen=True)
class MapRequest:
    url: str
    max_depth: int = 2
    use_sitemap: bool = True

    def __post_init__(self) -> None:
        _url(self.url)
        _within("max_depth", self.max_depth, 0, 100)


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = 10
    use_bm25: bool = True
    title_weight: float = 2.0
    snippet_weight: float = 1.0

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("query must not be empty")
        _within("limit", self.limit, 1, 100)
        _within("title_weight", self.title_weight, 0, 100)
        _within("snippet_weight", self.snippet_weight, 0, 100)


def scrape(pages: DataFrame, request: ScrapeRequest | None = None, robots_files: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Renderings of pages with ``success``, ``error``, ``warning`` and ``escalation``; binary paths and pages that robots rules deny are left out."""
    r = request or ScrapeRequest()
    rows = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))
    rows = rows.filter(~is_binary_path("url"))
    if robots_files is not None:
        rows = robots.gate(rows, robots_files, agent).filter("robots_allowed").drop("robots_allowed")
    facts = with_escalation(rows, out="escalation").select("page_id", "status", fetch_warning("html", "status").alias("warning"), "escalation")
    facts = facts.withColumn("route", fetch_route(F.lit(parse_render_mode(r.render_mode)), "escalation"))
    out = extract.scrape(rows, r.formats, r.extractor, r.include_tags, r.exclude_tags, r.css_selector, r.compat).join(facts, "page_id")
    failed = is_soft_failure("status", "markdown", "plain_text")
    return out.withColumn("success", ~failed).withColumn("error", F.when(failed, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))


def envelope(rows: DataFrame) -> DataFrame:
    """(page_id, json): the answer of each scraped page as one JSON document."""
    data = [c for c in rows.columns if c not in ("success", "error", "warning", "page_id")]
    return rows.select("page_id", F.to_json(F.struct("success", F.struct(*data).alias("data"), "error", "warning")).alias("json"))


def crawl(pages: DataFrame, request: CrawlRequest, edges: DataFrame | None = None, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    edges = crawling.page_edges(pages) if edges is None else edges
    return crawling.crawl(pages, edges, request.url, request.max_depth, request.max_pages, blocked)


def map_urls(pages: DataFrame | None, request: MapRequest, edges: DataFrame | None = None, sitemap: DataFrame | None = None) -> DataFrame:
    edges = crawling.page_edges(pages) if edges is None else edges
    return crawling.map_urls(edges, request.url, request.max_depth, sitemap if request.use_sitemap else None)


def search(hits: DataFrame, request: SearchRequest, renderings: DataFrame | None = None) -> DataFrame:
    return search_hits(hits, request.query, request.use_bm25, request.limit, renderings, request.title_weight, request.snippet_weight)


brand = extract.brand

__all__ = ["CrawlRequest", "MapRequest", "ScrapeRequest", "SearchRequest", "brand", "crawl", "envelope", "evaluate", "map_urls", "scrape", "search"]
