"""Inline inputs for behaviour that the stored tables don't show, as rows for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """(VALUES ...) AS t(names)."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


URLS = [
    (1, "https://example.com/a/"), (2, "http://EXAMPLE.com/A?q=1#top"), (3, "https://user@www.example.org:8443/x/y.PNG?z"), (4, "ftp://example.com/file"),
    (5, "http://localhost/admin"), (6, "http://app.localhost/x"), (7, "http://127.0.0.1/"), (8, "http://10.1.2.3:80/x"), (9, "http://192.168.0.9/x"),
    (10, "http://172.20.1.1/"), (11, "http://172.40.1.1/"), (12, "http://8.8.8.8/dns"), (13, "http://[::1]/x"), (14, "http://[2001:db8::1]/x"),
    (15, "http:///nohost"), (16, "https://example.com/%00x"), (17, "https://example.com/archive.tar"), (18, "https://example.com/doc.pdf"),
    (19, "https://example.com"), (20, "mailto:a@example.com"), (21, "https://sub.example.com/photo.jpeg#x"), (22, "http://169.254.1.1/meta"),
]
CONTENT_TYPES = [
    (1, "text/html; charset=utf-8"), (2, "IMAGE/PNG"), (3, " application/pdf "), (4, "application/octet-stream"), (5, "application/json"), (6, ""),
    (7, "video/mp4;codecs=x"), (8, "font/woff2"), (9, "application/x-unknown"), (10, "application/zip"), (11, "application/rss+xml"),
]
ERRORS = [
    (1, "dial tcp: connection refused"), (2, "x509: certificate has expired"), (3, "context deadline exceeded"), (4, "lookup: no such host"),
    (5, "unexpected EOF"), (6, "bad gateway"), (7, "tls handshake timeout"), (8, "read: connection reset by peer"),
]
STATUS = [(s,) for s in (200, 301, 400, 401, 403, 404, 405, 408, 410, 418, 429, 451, 500, 502, 503, 504)]
MARKERS = [
    "", "<div class=challenge-form>__cf_chl_f_tk=1</div>", "Pardon Our Interruption", "Reference #18.2d351ab8.1557333295.a4e16ab", "window._pxAppId = 'x'",
    "captcha-delivery.com", "_Incapsula_Resource", "Sucuri Website Firewall", "KPSDK.scriptStart = KPSDK.now()", "Generated by cloudfront",
    "Just a moment... Attention Required!", "_cf_chl_opt",
]
PATTERNS = [
    (1, "example.com", "EXAMPLE.com", True), (2, "example.com", "example.com/x", False), (3, "*.example.com", "a.Example.com", True),
    (4, "*.example.com", "example.com", False), (5, "https://*/api/*", "https://x.org/api/v1", True), (6, "~^https?://[a-z]+\\.org", "http://abc.org/x", True),
    (7, "~^ABC", "abc", False), (8, "~*^ABC", "abcd", True), (9, "a.c*", "abc", False), (10, "a.c*", "a.cde", True), (11, "*", "", True),
]
HREFS = [
    (1, "https://www.linkedin.com/company/acme/about"), (2, "https://twitter.com/acme"), (3, "https://x.com/home"), (4, "//github.com/acme/repo"),
    (5, "https://discord.com/invite/abc"), (6, "discord.gg/xyz"), (7, "https://facebook.com/pages/Acme/123"), (8, "https://facebook.com/groups/9"),
    (9, "https://instagram.com/acme/"), (10, "https://www.youtube.com/@acme/videos"), (11, "https://youtube.com/watch?v=1"), (12, "https://tiktok.com/@acme"),
    (13, "https://example.com/acme"), (14, "https://x.com/intent/tweet?text=a"), (15, "https://m.facebook.com/acme"), (16, "https://youtube.com/c/Acme"),
    (17, "https://discord.com/channels/1/2/3"), (18, "https://github.com/settings"), (19, "https://www.linkedin.com/IN/someone"),
]
COLORS = [(1, "#fff"), (2, "#A1b2C3"), (3, "#12345678"), (4, "#abcd"), (5, "#000000"), (6, "#fe0101"), (7, "#7f7f80"), (8, "#0a0a60"), (9, "#12345")]
IMAGES = [
    (1, "https://example.com/a.SVG", ""), (2, "https://example.com/favicon.ico", "image/png"), (3, "https://example.com/logo", "image/webp"),
    (4, "https://example.com/p.jpg", ""), (5, "https://example.com/x.bin", "application/x"), (6, "https://example.com/a.b/c", "image/x-icon"),
]
ADDRESSES = [
    (1, "Contact us. City: Springfield, State: Oregon, Zip: 97477, Country: Utopia\nend"), (2, "Location unknown"), (3, "city: Nowhere, no keyword here"),
    (4, "our address\ntown: Old Mill\npostal: AB1 2CD\n"),
]
DATES = [(1, "2024-03-05T14:07:00Z"), (2, "2024-03-05T14:07:59+02:00"), (3, "yesterday"), (4, "2024-03-05"), (5, "2023-12-31T23:30:00.250-01:00")]
TITLES = [(1, "News | Site", "t1"), (2, "A – B", "t2"), (3, "", "plain - title"), (4, None, "only"), (5, "One-Two", "x"), (6, "No separator", "y")]
WRAPPERS = [
    (1, "sidebar left", ""), (2, "post body", ""), (3, "x toc y", ""), (4, "tocx", ""), (5, "ads-top", ""), (6, "main", "Navigation"), (7, "cookie-bar", ""),
    (8, "story related", ""), (9, "unrelated", ""), (10, "", "main"),
]
MODES = [(1, "auto", "thin HTML content"), (2, "", ""), (3, "HTTP", "thin HTML content"), (4, " browser ", ""), (5, None, "x")]
BRAND_ANCHORS = '<a href="/blog-posts">Notes</a><a href="https://x.example.com/p">Our PRICING</a><a href="//y.example.com/contact">Reach us</a><a>Careers</a><a href="">terms</a>'
BRAND_ANCHOR_EVEN = '<a href="/careers/">Jobs</a><a href="/blog">Blog</a>'
CANDIDATE_NAMES = ("article body", "sidebar", "plain", "post content sidebar promo")
METAS = [
    "", '<meta name="description" content=" d ID "><meta property="og:title" content="T ID">', '<meta property="article:author" content="A ID"><link rel="canonical" href="/c/ID"><meta name="author" content="">',
    '<meta name="pubdate" content="P ID"><meta name="date" content="Q"><meta itemprop="dateModified" content="M &amp; ID"><meta property="og:image" content="i.png"><meta property="og:description" content="od ID">',
    '<meta name="author" content="B ID"><meta property="article:published_time" content="2024-01-ID"><meta name="lastmod" content="L"><meta property="article:modified_time" content="N ID">',
]
OPTIONS = [(1, "markdown", "off"), (2, "links,html", "strict"), (3, "", "moderate"), (4, None, None), (5, "markdown,markdown", "2"), (6, "x", "")]
HITS = [(1, "2024-01-01", "x"), (2, "", "2023"), (3, None, None), (4, None, "")]
IMG_PAGES = [(1, '<p><img src="/a.png"><img alt=x src=\'b.jpg\'><img src="data:x"></p>'), (2, "none"), (3, '<img data-x="1" src="https://example.com/c.gif?x=1&amp;y=2">')]


def edges(n: int = 400) -> list[tuple[str, str, int]]:
    """A site with cycles, self-loops, other origins and variants of one URL."""
    out, base = [], "https://site.example.com/p"
    for i in range(n):
        src = f"{base}{i}"
        for k, j in enumerate(((i * 2 + 1) % n, (i * 2 + 2) % n, (i * 7 + 3) % n)):
            out.append((src, f"{base}{j}" + ("/" if j % 3 == 0 else "#s" if j % 5 == 0 else ""), k))
        if i % 10 == 0:
            out += [(src, src, 3), (src, f"https://other.example.org/{i}", 4), (src, f"{base}{i}.png", 5), (src, "mailto:x@example.com", 6)]
    return out
