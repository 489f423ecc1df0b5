"""Article metadata, story parts, byte thresholds, colour names, nested sitemaps, and null keys."""

import pytest

from webloom.functions.color import named_points, nearest
from webloom.functions.dom import parse
from webloom.functions.readability import article_metadata, is_readable, is_story_part, readability
from webloom.operators import evaluate, extract, requests, search, sitemap

PROSE = "This sentence is long enough to be scored as prose, it has commas, and it goes on for quite a while before it ends. "


def test_metadata_names_in_their_order():
    html = """<head><title>Doc</title><meta name="title" content="plain"><meta property="og:title" content="og"><meta name="DC.title" content="dublin">
    <meta name="author" content="a"><meta property="dcterm:creator" content="c"><meta name="weibo:article:description" content="w"><meta property="twitter:description" content="t"></head>"""
    assert article_metadata(parse(html)) == ("dublin", "c", "w")
    assert article_metadata(parse('<meta property="og:title og:description" content=" x ">')) == ("x", None, "x")
    assert article_metadata(parse("<meta name='keywords' content='k'><meta name='title' content=''>")) == (None, None, None)


def test_article_takes_metadata_before_its_own_guesses():
    a = readability(f'<html><head><title>Doc</title><meta name="author" content="Ann"><meta name="description" content="In short."></head><body><div><p>{PROSE * 6}</p></div></body></html>')
    assert (a.title, a.byline, a.excerpt) == ("Doc", "Ann", "In short.")


def test_story_parts_split_by_a_widget_are_joined():
    card = lambda x: f'<div class="story-element-card"><p>{x} {PROSE * 4}</p></div>'
    html = f'<body><div><div class="a"><div>{card("First")}</div></div><div class="widget promo"><a href="/x">Read this</a></div><div class="b"><div>{card("Second")}</div></div></div></body>'
    content = readability(html).content
    assert "First" in content and "Second" in content and "Read this" not in content
    assert is_story_part(parse('<div itemprop="articleBody">').first("div")) and not is_story_part(parse('<div class="story">').first("div"))


def test_thresholds_count_bytes():
    text = "Текст" * 20  # 100 letters, 200 bytes
    assert not is_readable(f"<p>{'x' * 100}</p>" * 10) and is_readable(f"<p>{text}</p>" * 10)


def test_head_is_read_without_a_tree():
    page = "<html lang=de><head><title>A &amp; B</title><meta name=description content=' d '></head><body><p>x</p></body></html>"
    meta = extract.metadata(page)
    assert (meta["title"], meta["description"], meta["language"], meta["author"]) == ("A & B", "d", "de", None)
    late = "<body><p>x</p><title>Late</title><meta name=author content=Bo></body>"
    assert (extract.metadata(late)["title"], extract.metadata(late)["author"]) == ("Late", "Bo")


def test_colours_take_names_from_the_table_given(spark, tmp_path):
    assert nearest("#fe0101", named_points()) == "Red"
    assert nearest("#fff", named_points({"FF6700": "Blaze", "0A0A0A": "Night"})) == "Blaze"
    (tmp_path / "names.csv").write_text("#ff6700,Blaze\n0a0a0a,Night\n")
    from webloom.sources.readers import color_names

    names = color_names(spark, str(tmp_path / "names.csv"))
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<style>a{color:#000}b{color:#ff6600}</style>")], "page_id long, url string, html string")
    row = extract.brand(pages, names=names).first()
    assert row["colors"] == ["#000", "#ff6600"] and row["color_names"] == ["Night", "Blaze"]


def test_sitemaps_nest_without_limit(spark):
    index = lambda loc: f"<sitemapindex><sitemap><loc>{loc}</loc></sitemap></sitemapindex>"
    files = [(f"https://e.com/{i}.xml", index(f"https://e.com/{i + 1}.xml")) for i in range(9)]
    files.append(("https://e.com/9.xml", "<urlset><url><loc>https://e.com/page</loc></url><url><loc>https://e.com/0.xml</loc></url></urlset>"))
    out = sitemap.expand(spark.createDataFrame(files, "url string, xml string"), spark.createDataFrame([("https://e.com/0.xml",)], "url string"))
    assert [r["loc"] for r in out.collect()] == ["https://e.com/page"]


def test_null_keys_stay(spark):
    events = spark.createDataFrame([(1, None, 0.0), (2, "a", 0.0), (3, None, 1.0), (4, "a", 99.0)], "id long, key string, at double")
    out = {r["id"]: r["allowed"] for r in requests.limited(events, "key", "at", "id", 10.0, 1).collect()}
    assert out == {1: True, 2: True, 3: False, 4: True}
    asked = spark.createDataFrame([(1, None, 10, 5), (2, "a", 10, 5), (3, "a", 10, 1), (4, "a", 3, 9), (5, "a", 10, 0)], "id long, key string, at_s long, ttl_s long")
    cache = spark.createDataFrame([(None, 9), ("a", 8), ("a", 2), ("a", 50)], "key string, cached_at long")
    got = {r["id"]: (r["hit"], r["cached_at"]) for r in requests.cache_lookup(asked, cache).collect()}
    assert got == {1: (False, None), 2: (True, 8), 3: (False, None), 4: (True, 2), 5: (False, None)}


def test_percentiles_of_few_and_equal_values(spark):
    for values in ([], [5.0], [1.0, 1.0, 1.0], [1.0, 2.0, 3.0, 10.0], [float(x * x) for x in range(1000)]):
        import numpy as np

        got = evaluate.latency(spark.createDataFrame([(v,) for v in values], "ms double")).first()
        want = [round(float(np.percentile(values, q)), 1) if values else 0.0 for q in (50, 90, 95, 99)]
        assert [got["p50_ms"], got["p90_ms"], got["p95_ms"], got["p99_ms"]] == pytest.approx(want, abs=0.11) and got["n"] == len(values)


def test_full_ranking_is_gapless(spark):
    rows = spark.createDataFrame([(i, float(i * 7 % 13)) for i in range(300)], "id long, bm25_score double")
    out = [(r["position"], r["bm25_score"], r["id"]) for r in search.reranked(rows, "id").collect()]
    assert [p for p, _, _ in out] == list(range(1, 301)) and out == sorted(out, key=lambda r: (-r[1], r[2]))
