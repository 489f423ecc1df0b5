"""Crawls of many sites against one search each, seeds from sitemaps and robots files, and robots rules by prefix."""

import random

import pytest

from webloom.operators import crawl, robots


def sites(seed=1):
    """Links of three sites with cycles, one of them a hub that most links point from."""
    rng = random.Random(seed)
    edges = []
    for host, n in (("a", 60), ("b", 8), ("c", 25)):
        base = f"https://{host}.example.com/p"
        for i in range(n):
            edges += [(f"{base}{i}", f"{base}{rng.randrange(n)}" + rng.choice(["", "/", "#x"]), k) for k in range(3)]
        edges += [(f"{base}0", f"{base}{i}", 9) for i in range(0, n, 7)]
        edges += [(f"{base}1", "https://elsewhere.example.org/x", 5), (f"{base}1", f"{base}2.png", 6), (f"{base}2", "mailto:a@b.c", 7)]
    return edges


def norm(u):
    u = u.split("#")[0]
    return (u[:-1] if u.endswith("/") else u).lower()


def plain(edges, starts, depth, most):
    seen = {norm(u): 0 for u in starts}
    level = set(seen)
    host = {u.split("/")[2] for u in starts}
    for d in range(1, depth + 1):
        fresh = {norm(t) for s, t, _ in edges if norm(s) in level and t.startswith("http") and t.split("/")[2] in host and not t.endswith(".png")} - set(seen)
        level = set(sorted(fresh)[: max(0, most - len(seen))])
        seen |= dict.fromkeys(level, d)
    return seen


@pytest.mark.parametrize(("depth", "most"), [(1, 5000), (3, 5000), (6, 20), (2, 1)])
def test_each_crawl_is_that_of_its_seed_alone(spark, depth, most):
    edges = sites()
    starts = {"one": ["https://a.example.com/p3"], "two": ["https://a.example.com/p5", "https://a.example.com/p5/", "https://a.example.com/p9"], "b": ["https://b.example.com/p0"], "c": ["https://c.example.com/p1"], "none": ["https://z.example.com/"]}
    seeds = spark.createDataFrame([(s, u) for s, urls in starts.items() for u in urls], "seed string, url string")
    got = {}
    for r in crawl.traverse_many(spark.createDataFrame(edges, "src string, dst string, ord int"), seeds, depth, most).collect():
        got.setdefault(r["seed"], {})[r["norm"]] = r["depth"]
    assert got == {s: plain(edges, urls, depth, most) for s, urls in starts.items()}


def test_the_filter_loses_and_invents_nothing(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("CAST(id AS STRING) AS k")
    visited = spark.range(0, 4000, 3).selectExpr("CAST(id AS STRING) AS k")
    want = {str(i) for i in range(4000) if i % 3}
    for bits in (1 << 24, 1 << 16):  # nearly empty, and with many false hits
        monkeypatch.setattr(crawl, "FILTER_BITS", bits)
        assert {r["k"] for r in crawl.not_yet(rows, visited, "k").collect()} == want
    assert crawl.not_yet(rows, visited.limit(0), "k").count() == 4000


def test_seeds_come_from_pages_sitemaps_and_robots(spark):
    pages = spark.createDataFrame([("https://a.example.com/x",), ("https://a.example.com/b",), ("https://b.example.com/",), ("http://localhost/",)], "url string")
    site = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    maps = [
        ("https://a.example.com/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.example.com/more.xml</loc></sitemap></sitemapindex>"),
        ("https://a.example.com/more.xml", site("https://a.example.com/deep", "https://other.example.org/no", "https://a.example.com/sitemap.xml")),
        ("https://b.example.com/named.xml", site("https://b.example.com/listed")),
    ]
    files = [("https://b.example.com", "User-agent: *\nDisallow:\nSitemap: https://b.example.com/named.xml\n"), ("https://a.example.com", None)]
    got = crawl.site_seeds(pages, spark.createDataFrame(files, "origin string, text string"), spark.createDataFrame(maps, "url string, xml string")).collect()
    assert sorted((r["seed"], r["url"]) for r in got) == [
        ("https://a.example.com", "https://a.example.com/b"), ("https://a.example.com", "https://a.example.com/deep"), ("https://b.example.com", "https://b.example.com/"), ("https://b.example.com", "https://b.example.com/listed"),
    ]
    assert {r["seed"] for r in crawl.site_seeds(pages).collect()} == {"https://a.example.com", "https://b.example.com"}


def test_robots_rules_by_prefix_and_pattern(spark):
    rng = random.Random(4)
    lines = ["User-agent: *"] + [f"{rng.choice(['Allow', 'Disallow'])}: /" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6))) + rng.choice(["", "", "", "*c", "$", "*"]) for _ in range(300)]
    files = {"https://a.example.com": "\n".join(lines), "https://b.example.com": "User-agent: loombot\nDisallow: /a\n\nUser-agent: *\nDisallow: /", "https://c.example.com": None}
    urls = [(i, f"{rng.choice([*files, 'https://d.example.com'])}/" + "".join(rng.choice("abc/") for _ in range(rng.randint(0, 8))) + rng.choice(["", "?q=c", "#f"])) for i in range(400)] + [(1000, None), (1001, "https://b.example.com")]
    got = robots.gate(spark.createDataFrame(urls, "i int, url string"), spark.createDataFrame(list(files.items()), "origin string, text string"), "loombot/1.0").collect()
    assert len(got) == len(urls)
    for r in got:
        if r["url"] is None:
            assert r["robots_allowed"]
            continue
        host = "/".join(r["url"].split("/")[:3])
        assert r["robots_allowed"] == robots.allowed(files.get(host), r["url"], "loombot/1.0"), r["url"]
