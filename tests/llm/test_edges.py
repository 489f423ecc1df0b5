"""Odd rows, empty tables and clashing columns: every operator gives a defined result and drops nothing silently."""

from collections import Counter

import pytest

from webloom.llm import decontaminate, html_cut, langid, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, weak_quality


def operators(labels, benchmark):
    return {
        "op1": lambda d: quality_rules.apply_quality_rules(d, labels),
        "op2": sharding.shard_documents,
        "op4": lambda d: decontaminate.contamination(d, benchmark),
        "op5": langid.identify,
        "op6": suffix_dedup.remove_repeats,
        "op7": pii.pii_digest,
        "op8": ngram_join.jaccard_classes,
        "op9": mixing.mix,
        "op10": lambda d: weak_quality.classify(d, labels),
    }


NAMES = ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(name, odd_docs, labels, benchmark):
    out = operators(labels, benchmark)[name](odd_docs).collect()
    ids = Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    assert Counter(r["doc_id"] for r in out) == ids


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, no_docs, no_labels, benchmark, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert operators(no_labels, nothing)[name](no_docs).collect() == []


def test_known_answers_for_odd_rows(odd_docs, labels, benchmark):
    at = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    quality = at(quality_rules.apply_quality_rules(odd_docs, labels))
    assert not quality[4]["kept"] and quality[4]["n_words"] == 0 and quality[4]["base_failed"]
    assert quality[9]["n_repeat_words"] == quality[9]["n_words"] == 60_000
    mixed = at(mixing.mix(odd_docs))
    assert mixed[4]["size"] == mixed[4]["taken"] == 0
    lang = at(langid.identify(odd_docs))
    assert lang[4]["lang_pred"] == lang[5]["lang_pred"] == lang[6]["lang_pred"] == "und" and lang[4]["score"] == 0.0
    near = at(ngram_join.jaccard_classes(odd_docs))
    assert near[1]["class_id"] == near[2]["class_id"] == 1 and near[2]["n_links"] == 2 + (near[3]["class_id"] == 1)
    assert near[4]["class_id"] == 4 and near[5]["class_id"] == 5 and near[4]["n_links"] == 0
    cut = at(suffix_dedup.remove_repeats(odd_docs))
    assert cut[8]["n_removed"] == 150_000 and cut[8]["n_spans"] == 1 and cut[4]["n_bytes"] == 0 and cut[7]["n_removed"] == 0
    assert cut[1]["n_removed"] == cut[1]["n_bytes"]
    hits = at(decontaminate.contamination(odd_docs, benchmark))
    assert hits[7]["contaminated"] and hits[7]["n_items"] == 2 and hits[1]["n_hit"] == 30 and not hits[4]["contaminated"]
    shards = at(sharding.shard_documents(odd_docs))
    assert shards[4]["size"] == 1 and shards[4]["text_crc32"] == 0


def test_pages_with_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/x", None), (2, None, ""), (3, "u", "<p>" * 5000 + "deep"), (3, "u", "<p>" * 5000 + "deep"), (None, "u", "<div><p>Text &amp; more"), (5, "u", "plain < text > only"), (6, "u", "<a " + "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "kept")})
    out = html_cut.extract_main_text(pages).collect()
    assert Counter(r["page_id"] for r in out) == Counter(r[0] for r in rows)
    assert {r["page_id"]: r["text"] for r in out}[1] == ""
    assert html_cut.extract_main_text(pages.limit(0)).collect() == []
