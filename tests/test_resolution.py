"""References against bases: the JVM-side form, the per-row form and rules written out."""

import random

import duckdb
from pyspark.sql import functions as F

from webloom.functions import links, url
from webloom.plans import oracle

BITS = ["..", ".", "/", "a", "b.c", "é", "%41", "%zz", "?", "#", "x=1", "//", "http:", "HTTPS://h.Org", "ftp:", "@", "[", "]", ":80", ":99999", " ", "😀", "+", "~", "//h2.org", "\\", "x y", "ß?ü"]
BASES = ["https://a.com/x/y?z=1", "https://a.com", "http://u@b.org:8080/p/q/../r/", "", "https://a.com/x/./y#f"]


RULES = [
    ("g", "http://a/b/c/g"), ("./g/", "http://a/b/c/g/"), ("../g", "http://a/b/g"), ("../../../g", "http://a/g"), ("g/./h/../i", "http://a/b/c/g/i"), ("..", "http://a/b/"), (".", "http://a/b/c/"),
    ("?y", "http://a/b/c/d?y"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("//h/../p", "http://h/p"), ("HTTP://h/a/../b", "http://h/b"), ("x:y", "x:y"), ("a//b", "http://a/b/c/a//b"), ("#", "http://a/b/c/d?q"),
]


def test_rules(spark):
    base = "http://a/b/c/d?q"
    assert [url.resolve(base, h) for h, _ in RULES] == [w for _, w in RULES]
    got = spark.createDataFrame(RULES, "h string, want string").select(url.resolved(F.lit(base), "h").alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_all_three_forms_agree_on_odd_references(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(BASES), "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 6)))) for i in range(1500)]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, b string, h string").select("i", url.resolved("b", "h").alias("x")).collect()}
    assert got == {i: url.resolve(b, h) for i, b, h in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE refs (i INT, ord INT, url VARCHAR, raw VARCHAR)")
    con.executemany("INSERT INTO refs VALUES (?, 0, ?, ?)", rows)
    assert dict(con.execute(f"SELECT i, x FROM {oracle._resolved('SELECT * FROM refs', 'i')}").fetchall()) == {i: x for i, x in got.items() if x is not None}


def test_links_of_odd_pages(spark):
    html = "<a href=' /b/../c '>x</a><img src='i.png'><img src='data:x'><a href='mailto:q@x.org'>m</a><a href='%zz'>z</a> www.x.org/p"
    pages = spark.createDataFrame([(1, "https://s.org/d/e", html), (2, None, html), (3, "https://s.org", None), (4, "https://s.org", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["links"], r["image_links"]) for r in links.absolute_links(pages).collect()}
    assert got[1] == (["https://s.org/c", "https://www.x.org/p"], ["https://s.org/d/i.png"])
    assert got == {1: got[1], 2: (links.page_links(html, ""), links.page_images(html, "")), 3: ([], []), 4: ([], [])}


def test_no_python_worker(spark, sf):
    plan = links.absolute_links(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan and "Exchange" not in plan
