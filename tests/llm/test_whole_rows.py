"""Rows are judged by their own texts, whatever their ids."""

from tests.llm.conftest import make
from webloom.llm import decontaminate, ngram_join


def words(tag, n=50):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_one_of_each_class_stays_whatever_the_ids(spark):
    rows = [(None, words("a"), "en", "a"), (None, words("b"), "en", "a"), (None, words("b") + " tail", "en", "a"), (7, words("c"), "en", "a"), (7, words("d"), "en", "a"), (3, words("c") + " tail", "en", "a"), (9, words("a") + " tail", "en", "a")]
    kept = [(r["doc_id"], r["text"].split()[0]) for r in ngram_join.keep_one_of_each(make(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(9, "a0"), (None, "b0"), (3, "c0"), (7, "d0")], key=str)


def test_only_contaminated_rows_go(spark):
    bench = spark.createDataFrame([(1, words("bench", 20))], "item_id long, text string")
    rows = [(None, words("bench", 20), "en", "a"), (None, words("a"), "en", "a"), (5, words("b"), "en", "a"), (5, words("bench", 20), "en", "a")]
    kept = [(r["doc_id"], r["text"].split()[0]) for r in decontaminate.drop_contaminated(make(spark, rows), bench).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a0"), (5, "b0")], key=str)
