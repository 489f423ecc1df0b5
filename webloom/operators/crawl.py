"""Site traversal over stored links: crawl and map as level-synchronous breadth-first search.

The frontier of a level is one DataFrame: its links, filtered by safety, origin and robots rules, minus everything
visited (left anti join on the normalised URL). Each level is checkpointed to the shared folder, so the lineage stays
one level deep and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import is_binary_path, is_excluded_scheme, is_safe_url, normalize_url, origin
from webloom.operators.running import SLICE, dealt, row_numbers
from webloom.sources.shared import saved

MAX_DEPTH, MAX_PAGES, MAX_FOUND = 10, 1000, 5000


def _candidates(frontier: DataFrame, edges: DataFrame, base: DataFrame | None, blocked: DataFrame | None) -> DataFrame:
    rows = edges.join(frontier.select(F.col("norm").alias("_from")), normalize_url(F.col("src")) == F.col("_from"))
    rows = rows.filter(~is_excluded_scheme("dst") & is_safe_url("dst") & ~is_binary_path("dst"))
    rows = rows.filter(origin("dst") == origin("src")) if base is None else rows
    rows = rows.select(F.col("dst").alias("url"), normalize_url("dst").alias("norm"), F.col("_from").alias("parent"), "ord")
    if blocked is not None:
        rows = rows.join(blocked.select(normalize_url("url").alias("norm")).distinct(), "norm", "left_anti")
    return rows.groupBy("norm").agg(F.min(F.struct("parent", "ord", "url")).alias("x")).select("norm", F.col("x.url").alias("url"), F.col("x.parent").alias("parent"))


def traverse(edges: DataFrame, seed: str, max_depth: int = 3, max_found: int = MAX_FOUND, blocked: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """edges (src, dst, ord) -> (norm, url, parent, depth) reachable from ``seed``, same origin, at most ``max_found`` rows.

    The limit keeps the rows of the shallowest levels and, within a level, the first in order of (norm): it is the
    feature asked for, and deterministic. ``seeds`` (url) are further starts, as those of a sitemap.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(seed, None)], "url string, parent string").withColumn("norm", normalize_url("url"))
    if seeds is not None:
        more = seeds.filter(is_safe_url("url") & (origin("url") == origin(F.lit(seed)))).select("url", F.lit(None).cast("string").alias("parent"), normalize_url("url").alias("norm"))
        start = start.unionByName(more).dropDuplicates(["norm"])
    visited = saved(start.select("norm", "url", "parent", F.lit(0).alias("depth")), "bfs")
    frontier, n = visited, visited.count()
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        if n >= max_found:
            break
        fresh = _candidates(frontier, edges, None, blocked).join(visited.select("norm"), "norm", "left_anti")
        fresh = saved(fresh.orderBy("norm").limit(max_found - n).withColumn("depth", F.lit(depth)).select("norm", "url", "parent", "depth"), "bfs")
        found = fresh.count()
        if not found:
            break
        n += found
        visited = saved(visited.unionByName(fresh), "bfs")
        frontier = fresh
    return visited


def map_urls(edges: DataFrame, seed: str, max_depth: int = 3, sitemap: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(url): normalised URLs found from a seed, without the seed, in order."""
    found = traverse(edges, seed, max_depth, MAX_FOUND, blocked, sitemap)
    return found.filter(F.col("norm") != normalize_url(F.lit(seed))).select(F.col("norm").alias("url")).orderBy("url")


def crawl(pages: DataFrame, edges: DataFrame, seed: str, max_depth: int = 3, max_pages: int = 100, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, state): pages in breadth-first order up to ``max_pages``, joined with their stored content; and the counters."""
    found = traverse(edges, seed, max_depth, MAX_FOUND, blocked)
    first = found.orderBy("depth", "norm").limit(min(max_pages, MAX_PAGES))
    stored = pages.withColumn("norm", normalize_url("url")).dropDuplicates(["norm"]).drop("url")
    rows = first.join(stored, "norm", "inner")
    state = found.agg(F.count(F.lit(1)).alias("total")).crossJoin(rows.agg(F.count(F.lit(1)).alias("completed"))).withColumn("status", F.lit("completed"))
    return rows, state


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, ord) from the links of stored pages."""
    from webloom.functions.links import absolute_links

    links = absolute_links(pages).select("page_id", F.posexplode("links").alias("ord", "dst"))
    return links.join(pages.select("page_id", F.col("url").alias("src")), "page_id").select("src", "dst", "ord")


#: Bits of the filter in front of the visited join: two mebibytes, whatever has been visited.
FILTER_BITS = 1 << 24


def _bit(*key: str) -> Column:
    """A key's bit in a filter of FILTER_BITS bits, from 1."""
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)) + 1


def not_yet(rows: DataFrame, visited: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose key isn't among the visited ones. Most new rows are told by a Bloom filter of fixed size, which is broadcast; those that
    may have been visited, and no others, meet the visited table."""
    words = visited.select(_bit(*key).alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    d = rows.withColumn("_b", _bit(*key)).withColumns({"_at": F.bitmap_bit_position("_b"), "_block": F.bitmap_bucket_number("_b")})
    d = d.join(F.broadcast(words), "_block", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("long")
    maybe = F.coalesce(F.expr("_at % 8").cast("int"), F.lit(0))
    seen = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), maybe + 1)) > 0, F.lit(False))
    marked = d.withColumn("_seen", seen).select(*rows.columns, "_seen")
    sure = marked.filter("NOT _seen").drop("_seen")
    return sure.unionByName(marked.filter("_seen").drop("_seen").join(visited.select(*key).distinct(), list(key), "left_anti"))


def traverse_many(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_found: int = MAX_FOUND, blocked: DataFrame | None = None) -> DataFrame:
    """edges (src, dst, ord) and seeds (seed, url) -> (seed, norm, url, parent, depth): a breadth-first search from every seed at once.

    ``seed`` names a crawl; it may have several starts, as the URLs of its sitemap, which lie at depth 0 and are never cut. Each crawl keeps to the
    origins of its starts and to ``max_found`` rows: those of the shallowest levels and, within a level, the first by norm. The frontier of all crawls is
    one table keyed by (seed, norm), so a level is one join, whatever the number of crawls, and a crawl with most of the rows is ranked in slices.
    """
    starts = seeds.filter(is_safe_url("url")).select("seed", F.col("url"), normalize_url("url").alias("norm"), origin("url").alias("origin"))
    homes = saved(starts.select("seed", "origin").distinct(), "many-homes")
    first = starts.groupBy("seed", "norm").agg(F.min("url").alias("url")).select("seed", "norm", "url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    visited = saved(first, "many")
    links = edges.filter(~is_excluded_scheme("dst") & is_safe_url("dst") & ~is_binary_path("dst") & (origin("dst") == origin("src")))
    links = links.select(normalize_url("src").alias("parent"), F.col("dst").alias("url"), normalize_url("dst").alias("norm"), origin("dst").alias("origin"), "ord")
    if blocked is not None:
        links = links.join(blocked.select(normalize_url("url").alias("norm")).distinct(), "norm", "left_anti")
    links = saved(links, "many-links")
    frontier = visited
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        step = frontier.select("seed", F.col("norm").alias("parent")).join(links, "parent").join(homes, ["seed", "origin"], "left_semi")
        step = step.groupBy("seed", "norm").agg(F.min(F.struct("parent", "ord", "url")).alias("x")).select("seed", "norm", F.col("x.url").alias("url"), F.col("x.parent").alias("parent"))
        fresh = not_yet(step, visited.select("seed", "norm"), "seed", "norm")
        ranked = row_numbers(dealt(fresh, [F.col("seed"), F.col("norm")], tag="many-ranks"), ["seed"], [F.col("norm")], "_rank")
        room = visited.groupBy("seed").agg((F.lit(max_found) - F.count(F.lit(1))).alias("_room"))
        found = ranked.join(room, "seed").filter("_rank <= _room").withColumn("depth", F.lit(depth))
        frontier = saved(found.select("seed", "norm", "url", "parent", "depth"), "many")
        if not frontier.head(1):
            break
        visited = saved(visited.unionByName(frontier), "many")
    return visited


def crawl_many(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 100, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, states) of many crawls: each one's first ``max_pages`` URLs with their stored content, and (seed, total, completed, status)."""
    found = traverse_many(edges, seeds, max_depth, MAX_FOUND, blocked)
    by = [F.col("depth"), F.col("norm")]
    first = row_numbers(dealt(found, [F.col("seed"), *by], tag="many-pages"), ["seed"], by, "_rank").filter(F.col("_rank") <= min(max_pages, MAX_PAGES)).drop("_rank", SLICE)
    stored = pages.withColumn("norm", normalize_url("url")).dropDuplicates(["norm"]).drop("url")
    rows = first.join(stored, "norm")
    done = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("completed"))
    states = found.groupBy("seed").agg(F.count(F.lit(1)).alias("total")).join(done, "seed", "left")
    return rows, states.select("seed", "total", F.coalesce("completed", F.lit(0)).alias("completed"), F.lit("completed").alias("status"))


def site_seeds(pages: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """(seed, url): a crawl for each origin of ``pages``, from its first URL and from what its sitemaps list.

    ``robots`` (origin, text) names sitemaps, besides ``/sitemap.xml``; ``sitemaps`` (url, xml) are the stored files, which are followed through
    indexes. Listed URLs of other origins are left out, as in a crawl.
    """
    from webloom.operators.robots import sitemap_table
    from webloom.operators.sitemap import expand_many

    homes = pages.filter(is_safe_url("url")).groupBy(origin("url").alias("seed")).agg(F.min("url").alias("url"))
    if sitemaps is None:
        return homes
    named = homes.select("seed", F.concat("seed", F.lit("/sitemap.xml")).alias("url"))
    if robots is not None:
        named = named.unionByName(sitemap_table(robots).select(F.col("origin").alias("seed"), F.col("sitemap").alias("url")))
    listed = expand_many(sitemaps, named.distinct()).select("seed", F.col("loc").alias("url")).filter(origin("url") == F.col("seed"))
    return homes.unionByName(listed).distinct()
