"""Samples and shards hang on texts, not on ids or file layout; class names don't hide articles."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make
from tests.llm.test_operators import LONG
from webloom.llm import html_cut, langid, sharding


@pytest.mark.parametrize("names", ["post comments-open", "tag-news", "has-sidebar", "single popular", "legal-affairs", "comments", "format-status share"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_on_an_article_never_hide_it(names, tag):
    page = f'<body><div class="{names}"></div><{tag} class="{names}"><h1>A heading here</h1>' + f"<p>{LONG}</p>" * 4 + f"</{tag}></body>"
    assert html_cut.main_text(page) == " ".join(["A heading here", *[LONG] * 4])
    one = f'<body><{tag} class="{names}"><h1>A heading here</h1><p>{LONG}</p></{tag}></body>'
    assert html_cut.main_text(one) == f"A heading here {LONG}"


@pytest.mark.parametrize(("name", "hard", "soft"), [("site-footer", True, False), ("ad-box", True, False), ("cookie-notice", True, False), ("post-sign-up", True, False), ("has-sidebar", False, False), ("tag-news", False, False), ("comments-open", False, False), ("legal-affairs", False, False), ("popular", False, True), ("navigate", False, False), ("sidebar-wrap", True, False)])
def test_names_are_judged_whole(name, hard, soft):
    assert (html_cut.names_one(name, html_cut.HARD_NAMES), html_cut.names_one(name, html_cut.SOFT_NAMES)) == (hard, soft)


def test_a_notice_without_a_name_before_an_article_goes():
    notice = "We use cookies on this site to improve your experience, and so on and on."
    page = f"<body><div><p>{notice}</p></div><article><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></article></body>"
    assert html_cut.main_text(page) == f"A title {LONG} {LONG}"
    assert notice in html_cut.main_text(f"<body><div><p>{notice}</p><p>{LONG}</p></div></body>")  # nothing else speaks against it


def test_shares_are_pooled_until_they_rise():
    assert html_cut._rising([(1.0, 2.0), (0.0, 98.0), (50.0, 100.0)]) == [(1.0, 100.0), (1.0, 100.0), (50.0, 100.0)]


def test_sample_is_bounded_by_distinct_texts(spark):
    """Null and repeated ids, and copies, don't swell the sample."""
    rows = [(None if i % 2 else 7, f"text number {i // 3} of some words", "en", "a") for i in range(6000)]
    docs = make(spark, rows)
    seen = []
    model = langid.fit(docs, per_language=200)
    assert model.languages == ["en"]
    sample = langid.training(docs).select("lang", F.xxhash64("text").alias("h")).distinct().filter(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * 200 // 2000)
    seen = sample.count()
    assert 120 < seen < 300


def test_shards_hang_on_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0")).unionByName(make(spark, [(None, "same", "en", "a")] * 300).select(docs.columns))
    here = sharding.shard_documents(docs).collect()
    there = sharding.shard_documents(docs.repartition(11, "text").sortWithinPartitions(F.desc("doc_id"))).collect()
    by_row = lambda rows: {k: Counter(v) for k, v in _grouped(rows).items()}
    assert by_row(here) == by_row(there)
    sizes = Counter(r["shard"] for r in here)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(here) == docs.count()


def _grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"], r["text_crc32"]].append((r["shard"], r["slot"]))
    return out
