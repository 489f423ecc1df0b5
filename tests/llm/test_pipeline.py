"""The pipeline: stages work on all that came before, their decisions take effect, and it equals the operators in turn."""

from collections import Counter

import corpus_pipeline
from webloom.llm import decontaminate, mixing, ngram_join, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    at = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    kept = {r["doc_id"] for r in quality_rules.apply_quality_rules(docs, labels).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, at, sf).cache()
        if name != "sharding":
            assert at.columns == COLUMNS
        ids = [r["doc_id"] for r in at.select("doc_id").collect()]
        if name == "quality_rules":
            assert set(ids) == kept and len(ids) == len(kept)
        elif name == "ngram_jaccard_join":
            classes = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_classes(before).collect()}
            assert sorted(ids) == sorted(set(classes.values()))
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contamination(before, bench).filter("contaminated").collect()}
            assert set(ids) == {r["doc_id"] for r in before.collect()} - bad
        elif name == "mixing":
            words = Counter()
            for r in at.collect():
                words[r["doc_id"]] += len(r["text"].split())
                assert r["n_chars"] == len(r["text"])
            assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]})
        else:
            sizes = Counter(r["shard"] for r in at.collect())
            assert sum(sizes.values()) == before.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert corpus_pipeline.run(spark, sf).count() == at.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_one_of_each_group_stays(spark):
    from tests.llm.conftest import make

    text = " ".join(f"w{i}" for i in range(50))
    docs = make(spark, [(3, text, "en", "a"), (1, text + " tail", "en", "a"), (2, "something else entirely here now", "en", "a"), (1, text + " tail", "en", "a"), (4, None, None, None), (5, None, None, None)])
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(docs).collect()) == [1, 2, 4, 5]
