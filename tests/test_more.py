"""Design tokens, structured answers, the HTTP source and PDF pages in a scrape."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from webloom.functions import design
from webloom.operators import structured
from webloom.sources.http_pages import HttpPages, fetch, is_public


def test_design_tokens(spark):
    rows = [(1, '{"fonts": ["A", "B"], "styleguide": {"primaryColor": "#fff"}}'), (2, '{"fonts": {"C": "x"}, "styleguide": {"colors": ["#1"]}}'), (3, "no json"), (4, None)]
    out = {r["i"]: r for r in spark.createDataFrame(rows, "i int, j string").select("i", design.fonts("j").alias("f"), design.styleguide("j").alias("s")).collect()}
    assert out[1]["f"] == ["A", "B"] and out[2]["f"] == ["C"] and out[1]["s"]["primaryColor"] == "#fff" and out[2]["s"] is None and out[3]["f"] is None and out[4]["s"] is None


def test_fonts(spark):
    use = spark.createDataFrame([(1, "A", 2), (1, "B", 1), (1, "A", 3), (2, "A", 5)], "page_id int, family string, n_words int")
    assert {(r["page_id"], r["family"]): r["share"] for r in design.font_usage(use).collect()} == {(1, "A"): 83, (1, "B"): 17, (2, "A"): 100}
    files = spark.createDataFrame([("https://a/x.woff2",), ("https://b/y.woff2?v=1",), ("https://c/Z.woff",), ("https://d/q.ttf",)], "file_url string")
    faces = spark.createDataFrame([("X", "https://a/x.woff2"), ("Y", "https://other/y.woff2"), ("Z", "https://c2/z.ttf")], "family string, src_url string")
    assert {r["file_url"][8]: r["family"] for r in design.font_sources(files, faces).collect()} == {"a": "X", "b": "Y", "c": "Z", "d": None}


def test_shadows_and_icons(spark):
    s = spark.createDataFrame([(1, 0, "0px 1px 2px #000"), (1, 1, "0px 1px 3px #111"), (1, 2, "0px 1px 3px 0 #000"), (1, 3, "0px 9px 30px red")], "page_id int, ord int, shadow string")
    assert {r["bucket"]: r["shadow"] for r in design.shadow_buckets(s).collect()} == {"sm": "0px 1px 2px #000", "xl": "0px 9px 30px red"}
    i = spark.createDataFrame([(1, 0, "a", "16x16"), (1, 1, "b", "64x64"), (1, 2, "c", "64x64"), (1, 3, "d", "128x96"), (2, 0, "e", "any")], "page_id int, ord int, href string, sizes string")
    assert [(r["page_id"], r["href"], r["size"]) for r in design.best_icon(i).collect()] == [(1, "b", 64)]


def test_structured_answers(spark):
    schema = {"type": "object", "properties": {"title": {"type": "string"}, "n": {"type": "integer"}}, "required": ["title"]}
    base = structured.ModelSettings(prompt="p")
    assert structured.resolved(base, None, schema, None, "q") == structured.ModelSettings("q", schema) and base.schema is None
    d = spark.createDataFrame([(1, "Head\nbody"), (2, None)], "page_id long, markdown string")
    out = {r["page_id"]: r for r in structured.answers(d, "markdown", structured.ModelSettings("", schema)).collect()}
    assert json.loads(out[1]["json"]) == {"title": "Head", "n": 9} and out[1]["problem"] is None and out[2]["json"] is None
    bad = structured.answers(d, "markdown", structured.ModelSettings("", schema), lambda t, s, p: ["```json\n{}\n```" for _ in t]).filter("page_id = 1").first()
    assert bad["json"] == "{}" and bad["problem"] == "$: title is missing"


class Handler(BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):
        if self.path == "/retry" and Handler.tries == 0:
            Handler.tries += 1
            self.send_response(503)
            self.end_headers()
            return
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "Text/HTML; charset=utf-8")
        self.end_headers()
        self.wfile.write(f"<p>é {self.path}</p>".encode())

    def log_message(self, *args):
        pass


def test_http_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert not is_public(at) and fetch(at + "/x")[2] == 0 and is_public("https://example.com/") and not is_public("http://10.0.0.1/") and not is_public("ftp://example.com")
        assert fetch(at + "/retry", allow_private=True)[2] == 200
        spark.dataSource.register(HttpPages)
        rows = spark.read.format("webloom-pages").option("urls", f"{at}/a\n{at}/none").option("allow_private", "true").load().collect()
        assert {r["url"][-2:]: (r["status"], r["content_type"], r["html"]) for r in rows} == {"/a": (200, "text/html", "<p>é /a</p>"), "ne": (404, "text/html", "<p>é /none</p>")}
    finally:
        server.shutdown()


def test_pdf_pages_in_a_scrape(spark):
    from webloom.api import ScrapeRequest, scrape

    raw = b"%PDF-1.4\nstream\nBT (Text of a small document) Tj ET\nendstream"
    p = spark.createDataFrame([(1, "https://a.com/d", "", "application/pdf", raw), (2, "https://a.com/x", "<p>html here</p>", "text/html", None)], "page_id long, url string, html string, content_type string, raw binary")
    out = {r["page_id"]: r for r in scrape(p, ScrapeRequest(["markdown", "plainText"])).collect()}
    assert out[1]["markdown"] == out[1]["plain_text"] == "Text of a small document" and "html here" in out[2]["markdown"]
