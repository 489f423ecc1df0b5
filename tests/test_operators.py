"""Operators over DataFrames against Python models and inline cases."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from webloom.api import CrawlRequest, MapRequest, ScrapeRequest, SearchRequest, crawl, envelope, map_urls, parse_render_mode, scrape, search
from webloom.operators import evaluate, extract, json_check, pdf, requests, robots, sitemap
from webloom.operators.search import bm25f


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_scrape_gives_only_what_is_asked_for(spark):
    p = pages(spark, [(1, "https://a.com/x", "<title>T</title><p>hello</p>"), (2, "https://a.com/y.png", "bin"), (3, "https://a.com/z", None)])
    rows = {r["page_id"]: r for r in scrape(p, ScrapeRequest(["links", "plainText"])).collect()}
    assert set(rows) == {1, 3} and rows[1]["markdown"] is None and rows[1]["plain_text"] == "hello" and rows[1]["title"] == "T" and rows[3]["plain_text"] == ""
    answer = json.loads(envelope(scrape(p)).filter("page_id = 1").first()["json"])
    assert answer["success"] is True and answer["data"]["title"] == "T"


def test_soft_failure_and_warning(spark):
    p = pages(spark, [(1, "https://a.com/x", "<p>nope</p>")]).withColumn("status", F.lit(404))
    row = scrape(p).first()
    assert row["success"] is False and row["error"] == "HTTP 404" and row["warning"] == "<p>nope</p>" and row["route"] == "browser"


@pytest.mark.parametrize(
    "make",
    [lambda: ScrapeRequest(["nope"]), lambda: ScrapeRequest(render_mode="x"), lambda: CrawlRequest("ftp://x"), lambda: CrawlRequest("https://x", max_pages=0), lambda: MapRequest("x"), lambda: SearchRequest(" "), lambda: SearchRequest("a", limit=1000)],
)
def test_requests_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_formats_and_modes():
    assert extract.parse_formats(["extract", "json", "links"]) == ["json", "links"] and extract.parse_formats(None) == ["markdown"] and parse_render_mode(" HTTP ") == "http"


def test_metadata_priorities(spark):
    html = '<html lang="en-GB"><head><meta name="byl" content="Third"><meta property="article:author" content=" Second "><meta name=date content="2024-01-01"><link rel=canonical href=/c><title> x </title></head>'
    row = extract.page_metadata(pages(spark, [(1, "u", html)])).first()
    assert (row["author"], row["published_time"], row["canonical_url"], row["title"], row["language"], row["description"]) == ("Second", "2024-01-01", "/c", "x", "en-GB", None)


def test_brand(spark):
    html = (
        '<html lang="de-AT"><head><meta property="og:site_name" content="Acme"><style>a{color:#FFF}b{color:#fff;c:#abcdef}</style><link rel="icon" href="/i.ico"></head>'
        '<body><footer><a href="https://twitter.com/acme">x</a><a href="/privacy">Privacy</a> Address: City: Wien, Country: Austria\n</footer></body></html>'
    )
    b = extract.brand(pages(spark, [(1, "https://www.acme.com/p", html)]), tokens=spark.createDataFrame([(1, ["#ABCDEF", "#010203"])], "page_id long, colors array<string>")).first()
    assert (b["domain"], b["title"], b["language"], b["colors"]) == ("acme.com", "Acme", "de", ["#fff", "#abcdef", "#010203"])
    assert [x["url"] for x in b["logos"]] == ["https://www.acme.com/i.ico", "https://acme.com/favicon.ico"] and b["socials"][0]["url"] == "https://x.com".replace("x.com", "x.com") + "/acme"
    assert b["links"]["privacy"] == "https://acme.com/privacy" and b["address"]["city"] == "Wien" and b["address"]["country"].startswith("Austria")


ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.gif$\nSitemap: https://a.com/s.xml\n\nUser-agent: bot\nUser-agent: other\nDisallow: /\nAllow: /ok\n"


@pytest.mark.parametrize(
    ("agent", "path", "want"),
    [("*", "/", True), ("x", "/private/a", False), ("x", "/private/open/1", True), ("x", "/a.gif", False), ("x", "/a.gif?x", True), ("bot/2", "/x", False), ("Other", "/ok", True), ("", "/private/", False)],
)
def test_robots(spark, agent, path, want):
    assert robots.allowed(ROBOTS, path, agent) is want
    u = spark.createDataFrame([("https://a.com" + path,), ("https://b.com/",)], "url string")
    got = robots.gate(u, spark.createDataFrame([("https://a.com", ROBOTS)], "origin string, text string"), agent or "*")
    assert {r["url"]: r["robots_allowed"] for r in got.collect()} == {"https://a.com" + path: want, "https://b.com/": True}
    assert robots.sitemaps(ROBOTS) == ["https://a.com/s.xml"] and robots.allowed(None, "/x")


def test_sitemaps_expand(spark):
    files = [("https://a.com/i.xml", "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"), ("https://a.com/s.xml", "<s:urlset xmlns:s='x'><s:url><s:loc><![CDATA[https://a.com/1]]></s:loc></s:url><!-- <loc>no</loc> --><url><loc>https://a.com/2</loc>"), ("https://a.com/bad", "<loc>x</loc>")]
    d = spark.createDataFrame(files, "url string, xml string")
    assert sorted(r["loc"] for r in sitemap.expand(d, d.filter("url LIKE '%i.xml'")).collect()) == ["https://a.com/1", "https://a.com/2"]


def test_crawl_and_map(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    p = pages(spark, [(1, "https://a.com/", link("/b", "/C/", "https://z.org/")), (2, "https://a.com/b", link("/d", "/")), (3, "https://a.com/c", ""), (4, "https://a.com/d", link("/e"))])
    assert [r["url"] for r in map_urls(p, MapRequest("https://a.com/", 2)).collect()] == ["https://a.com/b", "https://a.com/c", "https://a.com/d"]
    rows, state = crawl(p, CrawlRequest("https://a.com/", 2, 3))
    assert sorted(r["page_id"] for r in rows.collect()) == [1, 2, 3] and state.first()["total"] == 4
    sm = spark.createDataFrame([("https://a.com/only-in-map",)], "url string")
    assert "https://a.com/only-in-map" in [r["url"] for r in map_urls(p, MapRequest("https://a.com/", 1), sitemap=sm).collect()]


def test_bm25_matches_a_plain_model(spark):
    import math

    docs = [(0, "go lang", "a go tutorial"), (1, "rust", "go go go and rust"), (2, "", "nothing here")]
    got = {r["ord"]: r["bm25_score"] for r in bm25f(spark.createDataFrame(docs, "ord int, title string, snippet string"), "Go rust go").collect()}
    tok = lambda s: s.lower().split()
    avg = [sum(len(tok(d[f])) for d in docs) / 3 for f in (1, 2)]
    for i, *fields in docs:
        score = 0.0
        for term in ("go", "rust", "go"):
            df = sum(any(term in tok(d[f]) for d in docs) for f in (1, 2))
            idf = math.log((3 - df + 0.5) / (df + 0.5) + 1)
            for text, w, a in zip(fields, (2.0, 1.0), avg, strict=True):
                tf = tok(text).count(term)
                score += idf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tok(text)) / a)) if tf else 0.0
        assert got[i] == pytest.approx(score)


def test_search_keeps_hits_without_content(spark):
    hits = spark.createDataFrame([("https://a.com", "go", "go text"), ("https://b.com", "x", None)], "url string, title string, content string")
    out = search(hits, SearchRequest("go", limit=5), spark.createDataFrame([("https://a.com", "# md")], "url string, markdown string")).collect()
    by = {r["url"]: r for r in out}
    assert by["https://a.com"]["position"] == 1 and by["https://b.com"]["bm25_score"] is None and by["https://b.com"]["markdown"] is None


def test_evaluation(spark):
    rows = [("u1", True, "The [quick brown](x) fox jumps over it", "quick brown fox jumps\nshort", "leaky phrase", 10.0, None), ("u2", False, "", "", "", 30.0, "404 not found"), ("u3", True, "has the leaky phrase", "", "leaky phrase\nother forbidden", 20.0, None)]
    scored, summary = evaluate.evaluate(spark.createDataFrame(rows, "url string, ok boolean, markdown string, truth_text string, lie_text string, ms double, reason string"))
    s, t = {r["url"]: r for r in scored.collect()}, summary.first()
    assert s["u1"]["enough_found"] and not s["u1"]["leaked"] and s["u3"]["leaked"] and not s["u3"]["has_truth"]
    assert (t["total_urls"], t["succeeded"], t["with_truth"], t["matched"], t["leaked_urls"], t["success_rate"], t["clean_rate"], t["p50_ms"]) == (3, 2, 1, 1, 1, 66.67, 50.0, 15.0)
    assert evaluate.latency(spark.createDataFrame([], "ms double")).first()["p99_ms"] == 0.0


def test_limiter_counts_only_what_passed(spark):
    ok, _ = requests.accept([0, 1, 2, 3, 10.5, 11], 10, 2)
    assert ok == [True, True, False, False, True, True]
    rows = [(k, i, float(t)) for k in ("a", "b") for i, t in enumerate([0, 1, 2, 3, 10.5, 11])]
    got = requests.limited(spark.createDataFrame(rows, "k string, i long, t double"), "k", "t", "i", 10, 2).collect()
    assert {(r["k"], r["i"]): r["allowed"] for r in got} == {(k, i): ok[i] for k in ("a", "b") for i in range(6)}


def test_pacing_is_the_recurrence(spark):
    at = [0, 10, 20, 500, 505, 506]
    got = {r["i"]: r["start_ms"] for r in requests.paced(spark.createDataFrame([("d", i, t) for i, t in enumerate(at)], "d string, i long, t long"), "d", "t", "i", 100).collect()}
    start, want = None, []
    for t in at:
        start = t if start is None else max(t, start + 100)
        want.append(start)
    assert [got[i] for i in range(len(at))] == want


def test_cache(spark, tmp_path):
    r = spark.createDataFrame([("k", 100, 50), ("k", 200, 50), ("k", 100, 0)], "key string, at_s long, ttl_s long")
    c = spark.createDataFrame([("k", 60), ("k", 90), ("k", 120)], "key string, cached_at long")
    assert [x["cached_at"] for x in requests.cache_lookup(r, c).orderBy("at_s", "ttl_s").collect()] == [None, 90, None]
    requests.cache_write(spark.createDataFrame([("k", "https://a.com", "{}", 0)], "key string, url string, data string, ttl_s long"), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.first()["ttl_s"] == 86_400 and requests.cache_without(back, spark.createDataFrame([("https://a.com",)], "url string")).count() == 0


SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"enum": ["x", 1]}, "c": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("text", "ok"),
    [('{"a": 1}', True), ('{"a": 1.0, "b": "x"}', True), ('{"a": true}', False), ("{}", False), ('{"a": 1, "z": 0}', False), ('{"a": 1, "c": ["q", 2]}', False), ('{"a": 1, "b": true}', False), ("no json", False), (None, False)],
)
def test_json_schema(spark, text, ok):
    assert (json_check.check_text(text, SCHEMA) is None) is ok
    assert (json_check.checked(spark.createDataFrame([(1, text)], "i int, t string"), "t", SCHEMA).first()["problem"] is None) is ok


def test_pdf(spark, tmp_path):
    body = b"BT (Hello \\(PDF\\)) Tj [(wor) -20 (ld of text that is long enough to count as text)] TJ ET"
    raw = b"%PDF-1.4\n1 0 obj <</Type /Pages>> 2 0 obj <</Type /Page>> /Title (A \\164itle)\nstream\n" + zlib.compress(body) + b"\nendstream\n%%EOF"
    assert pdf.pdf_text(raw) == "Hello (PDF)\nworld of text that is long enough to count as text" and pdf.pdf_info(raw) == ("text", "A title", 1, True)
    (tmp_path / "x.pdf").write_bytes(raw)
    (tmp_path / "y.pdf").write_bytes(b"junk")
    from webloom.sources.readers import pdfs

    rows = {r["path"][-5:]: r for r in pdf.pdf_documents(pdfs(spark, str(tmp_path))).collect()}
    assert rows["x.pdf"]["pages"] == 1 and rows["y.pdf"]["kind"] == "unknown"
