"""Column functions and Python functions on inline cases, and both forms of a rule against each other."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import classify, color, html_text, links, pattern, url
from webloom.functions.dom import compile_selector, parse, select, serialize
from webloom.functions.readability import content_score, is_noise_wrapper, is_readable, main_content, preprocess, readability
from webloom.functions.render import markdown, plain_text
from webloom.functions.tokens import tokens


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


SHELL = '<html><body><div id="root"></div></body></html>'
LONG = "<html><body><p>" + "plain words of a page " * 60 + "</p></body></html>"


@pytest.mark.parametrize(
    ("html", "status", "reason"),
    [
        (SHELL, 200, "SPA shell detected"),
        (SHELL, 404, "SPA shell detected"),
        (LONG, 200, ""),
        (LONG, 404, "soft-block status HTTP 404"),
        (LONG, 302, ""),
        ("<html><body>tiny</body></html>", 200, "thin HTML content"),
        (LONG + "<!-- _cf_chl_opt -->", 200, "Cloudflare challenge detected"),
        ("<html><body>" + "verify you are human " * 20 + "</body></html>", 200, "generic anti-bot wall detected"),
        ("<!-- captcha-delivery.com -->" + LONG, 200, "anti-bot vendor block: datadome"),
        ("<html>no body at all</html>", 200, ""),
        ("<html><noscript>Please enable JavaScript</noscript><body>" + "x " * 2000, 500, "SPA shell detected"),
    ],
)
def test_escalation_in_order(spark, html, status, reason):
    row = spark.createDataFrame([(html, status)], "html string, status int").select(classify.escalation("html", "status").alias("r")).first()
    assert row["r"] == reason


def test_first_bytes_never_splits_a_character(spark):
    from webloom.functions.base import first_bytes

    assert one(spark, "aéb", lambda c: first_bytes(F.col(c), 2)) == "a"
    assert one(spark, "aéb", lambda c: first_bytes(F.col(c), 3)) == "aé"


def test_body_text_bytes(spark):
    f = lambda h: one(spark, h, html_text.body_text_bytes)
    assert f("no tag") == 1000
    assert f("<body>never ends") == 0
    assert f("<body class=x>a  <b>b</b>\n c<script>x</script></body>") == len("a b c")
    assert f("<body>é<script>no end</body>") == 2


@pytest.mark.parametrize(("p", "x", "want"), [("a*c", "ABC", True), ("a*c", "abcd", False), ("~^a.c$", "abc", True), ("~*^A", "abc", True), ("a.c", "abc", False), ("A.C", "a.c", True)])
def test_patterns(spark, p, x, want):
    assert one(spark, x, lambda c: pattern.matches(c, p)) is want


def test_bad_patterns_are_dropped():
    assert pattern.valid(["", "~[", "*ok*"]) == ["*ok*"]
    with pytest.raises(ValueError):
        pattern.compiled("~(")


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.com/x/y", "z", "https://a.com/x/z"), ("https://a.com/x/", "../q?a=1#f", "https://a.com/q?a=1#f"), ("https://a.com", "/é ü", "https://a.com/%C3%A9%20%C3%BC"),
        ("https://a.com/x", "//b.org/p", "https://b.org/p"), ("https://a.com/x", "http://b.org:99999/", None), ("https://a.com/x", "/%zz", None), ("https://a.com/x?y", "", "https://a.com/x?y"),
    ],
)
def test_resolve(base, href, want):
    assert url.resolve(base, href) == want


def test_links_keep_first_and_order(spark):
    html = '<a href="/b">x</a><a href="/a">y</a><a href="/b#">z</a><a href="mailto:q@example.com">m</a> see http://www.example.com/p'
    found = links.page_links(html, "https://s.org/")
    assert found[:2] == ["https://s.org/b", "https://s.org/a"] and found[-2:] == ["http://www.example.com/p", "https://www.example.com/p"] and len(found) == len(set(found))
    assert one(spark, html, lambda c: F.size(links.raw_hrefs(c))) == 4


def test_hsl_and_nearest_name(spark):
    d = spark.createDataFrame([("#ff0000",), ("#fe0201",), ("#08f",)], "hex string")
    rows = {r["hex"]: r for r in color.nearest_name(d, "hex").collect()}
    assert rows["#ff0000"]["color_name"] == "Red" and rows["#ff0000"]["color_distance"] == 0 and rows["#fe0201"]["color_name"] == "Red"
    h = spark.createDataFrame([("#336699",)], "x string").select(color.hsl(color.rgb("x")).alias("h")).first()["h"]
    assert tuple(h) == (210, 49, 40)  # cut, not rounded


def test_tokenizer_survives_malformed_markup():
    html = "<p class='a\"b' <b>x</b> < y <!-- c --> &amp; <script>if (a<b) '</p>'</script>z<"
    assert "".join(v for k, v, _ in tokens(html) if k == 0).strip().endswith("z<")
    for bad in ("<", "<a", "<a href=\"x", "<!--", "</", "<script>", "<p" * 2000, "<div>" * 3000):
        serialize(parse(bad))


def test_tree_closes_what_is_implied():
    assert serialize(parse("<p><b>x<p>y</b>z<ul><li>1<li>2</ul>")) == "<html><head></head><body><p><b>x</b></p><p><b>y</b>z</p><ul><li>1</li><li>2</li></ul></body></html>"
    assert serialize(parse("<table><tr><td>a<td>b<tr><td>c</table>d")).endswith("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>d</body></html>")


def test_selectors():
    doc = parse('<footer id=f><div class="x social-y"><a href="/q" rel="me">1</a></div></footer><a>2</a>')
    count = lambda s: len(select(doc, s))
    assert [count(s) for s in ("a", "footer a", "#f a", ".x a", "[class*='social'] a", "a[href^='/']", "a[rel=me], a", "div > a".replace(" > ", " "), "p a")] == [2, 1, 1, 1, 1, 1, 2, 1, 0]
    with pytest.raises(ValueError):
        compile_selector("a:hover")


def test_markdown_has_no_images_and_plain_text_no_tags():
    html = "<h2>T</h2><p>a <em>b</em> <a href='/x'>l</a><img src=i></p><ul><li>one<li>two</ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table><pre>k\n v</pre>"
    md = markdown(html)
    assert md == "## T\n\na *b* [l](/x)\n\n- one\n- two\n\n| h |\n| --- |\n| c |\n\n```\nk\n v\n```"
    assert plain_text(html) == "Ta b lonetwohck v"


ARTICLE = "<html><head><title>A long enough title of six words | Site</title></head><body><div class='sidebar'><p>" + "menu text, more, " * 10 + "</p></div><div class='post'><p class='byline'>By Someone</p>" + "".join(f"<p>Paragraph {i} has prose, with commas, and it goes on for a while so that it counts.</p>" for i in range(12)) + "</div></body></html>"


def test_readability_finds_the_article():
    a = readability(ARTICLE, "https://a.com/")
    assert a.byline == "By Someone" and "Paragraph 11" in a.content and "menu text" not in a.content and a.title == "A long enough title of six words"
    assert is_readable(ARTICLE.replace("counts.", "counts. " + "And more of it here. " * 6)) and not is_readable("<p>short</p>")


def test_selector_tiers_and_filters():
    html = "<html><body><nav class='global-nav'>n</nav><div class='entry-content'>" + "<p>" + "text of the entry " * 30 + "</p></div><div class='widget'>w</div></body></html>"
    assert "text of the entry" in main_content(html) and "widget" not in main_content(html)
    assert preprocess(html, include=["p"]).startswith("text of the entry") and preprocess(html, css=".nothing") == ""
    assert "text of" not in preprocess(html, exclude=["p"])
    assert is_noise_wrapper("cookie-bar") and not is_noise_wrapper("story") and content_score(40, 100, 0, 1.0) == 0.0


def test_retry_rules(spark):
    f = lambda m: one(spark, m, classify.is_retriable_error)
    assert f("i/o timeout") and not f("x509: timeout") and not f("bad request")
