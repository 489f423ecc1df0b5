"""Rules learn from every labelled document: none is left out by a bound on their number."""

import re

from pyspark.sql import functions as F

from webloom.llm import quality_rules, weak_quality
from webloom.llm.common import likely

from .conftest import make


def corpus(spark, n=60):
    prose = lambda i: " ".join(f"word{(i * 31 + j) % 977}q{i}" for j in range(40))
    rows = [(i, prose(i) + (" vilest slurry" if i % 5 == 0 else ""), "en", "a") for i in range(n)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_no_bound_on_labels(spark, monkeypatch):
    """No limit is ever set on labelled documents, and all good ones of the held-out quarters are trials."""
    rows, labels = corpus(spark)
    limited, limit = [], type(labels).limit
    monkeypatch.setattr(type(labels), "limit", lambda self, n: (limited.append(self.columns), limit(self, n))[1])
    _, chosen = quality_rules.learn(make(spark, rows), labels, 0.05, 0.05)
    assert limited and not [c for c in limited if "doc_id" in c]
    held = labels.filter((quality_rules.fold() != 0) & (F.col("toxic") == 0)).count()
    assert chosen["language en"][2] + chosen["language other"][2] == held


def test_terms_count_each_text_once(spark):
    """Copies under other ids and rows repeated as a whole count as one text, under the least id."""
    rows, labels = corpus(spark, 30)
    more = [*rows, rows[0], rows[0], (1000, rows[3][1], "en", "a")]
    more_labels = labels.unionByName(spark.createDataFrame([(1000, 1, 1)], labels.schema))
    found = lambda r, known: sorted(map(tuple, quality_rules.lexicon_counts(make(spark, r), known, (0, 1, 2, 3)).collect()))
    counts = found(rows, labels)
    assert counts and found(more, more_labels) == counts
    assert sum(c + t for term, _, c, t in counts if term == "") == 30


def test_no_bound_on_good_documents(spark, monkeypatch):
    """op10's cut-offs and lexicons see every labelled document."""
    rows, labels = corpus(spark)
    limited, limit = [], type(labels).limit
    monkeypatch.setattr(type(labels), "limit", lambda self, n: (limited.append(self.columns), limit(self, n))[1])
    seen = []
    learned = weak_quality.learned_cutoffs
    monkeypatch.setattr(weak_quality, "FEWEST", 1)
    monkeypatch.setattr(weak_quality, "learned_cutoffs", lambda *args: (seen.append(args[2:]), learned(*args))[1])
    assert weak_quality.classify(make(spark, rows), labels, sample_rows=8).count() == 60
    assert seen == [()] and limited and not [c for c in limited if "doc_id" in c]


def test_no_bound_in_the_first_stage(spark, monkeypatch):
    """The pipeline's filter learns from every labelled document, and keeps what op1 keeps."""
    rows, labels = corpus(spark)
    limited, limit = [], type(labels).limit
    monkeypatch.setattr(type(labels), "limit", lambda self, n: (limited.append(self.columns), limit(self, n))[1])
    kept = {r["doc_id"] for r in quality_rules.filter_by_quality(make(spark, rows), labels).collect()}
    assert limited and not [c for c in limited if "doc_id" in c]
    assert kept == {r["doc_id"] for r in quality_rules.apply_quality_rules(make(spark, rows), labels).filter("kept").collect()}


def test_every_labelled_text_is_fitted_on_or_judged(spark):
    """The two parts of the labels are apart and leave no labelled document out."""
    _, labels = corpus(spark, 400)
    quarters = {r["q"]: r["count"] for r in labels.groupBy(quality_rules.fold().alias("q")).count().collect()}
    assert sorted(quarters) == [0, 1, 2, 3] and sum(quarters.values()) == 400


def exchanged(df):
    """The columns of each shuffle of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"\) Exchange *\nInput \[\d+\]: \[(.*)\]", plan)]


def test_texts_of_clean_documents_stay(spark, monkeypatch):
    """However many labels there are, the texts of harmless documents are not shuffled to them."""
    rows, labels = corpus(spark)
    plans, written = {}, quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda df, tag: (plans.setdefault(tag, exchanged(df)), written(df, tag))[1])
    docs = make(spark, rows)
    as_broadcast = sorted(map(tuple, quality_rules.lexicon_counts(docs, labels, (0,)).collect()))
    plans.clear()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, quality_rules.lexicon_counts(docs, labels, (0,)).collect())) == as_broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [c for c in plans["lexicon-toxic"] if "text" in c]  # few, and found by the pattern
    assert plans["lexicon-clean"] and not [c for c in plans["lexicon-clean"] if "text" in c]


def test_likely_rows(spark):
    """Every row with a wanted key passes, few others do, and nulls and clashing columns do no harm."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    keys = spark.range(0, 20_000, 7).select(F.col("id").alias("doc_id"))
    got = likely(rows, keys, "doc_id")
    assert got.columns == rows.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert set(range(0, 20_000, 7)) <= set(ids) and len(ids) == len(set(ids)) < 3_000
    assert likely(rows, keys.limit(0), "doc_id").count() == 0


def test_counts_by_hand(spark):
    """Every term that toxic documents use often is counted over all labelled documents of the quarters asked for."""
    rows, labels = corpus(spark, 120)
    counts = {(r["term"], r["fold"]): (r["clean"], r["toxic"]) for r in quality_rules.lexicon_counts(make(spark, rows), labels, (0, 1, 2, 3)).groupBy("term", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    quarter = {r["doc_id"]: r["f"] for r in labels.select("doc_id", quality_rules.fold().alias("f")).collect()}
    by_hand = {}
    for i, text, *_ in rows:
        own = set(quality_rules.letter_words(text))
        for w in own | quality_rules.stems(own) | {b""}:
            n = by_hand.setdefault(w.hex(), {}).setdefault(quarter[i], [0, 0])
            n[i % 5 == 0] += 1
    often = {w: n for w, n in by_hand.items() if sum(t for _, t in n.values()) >= 4}
    assert len(often) > 2 and counts == {(w, f): tuple(n) for w, each in often.items() for f, n in each.items()}
