import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("rid", "size", "kept", "h", "c", "node", "hub", "shard", "slot", "words", "n_words", "target", "taken", "_id", "key", "bucket", "quality", "toxic", "held_out", "spans", "_gone")


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    from pyspark.sql import functions as F

    prose = " ".join(f"word{i % 97}x{i % 13}" for i in range(120)) + "."
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose, "fr", "b"), (3, prose.replace("word5x", "other"), None, None), (4, None, "en", "a"),
        (5, "", "de", "b"), (6, " \t\n ", "de", None), (7, "one two", "en", "c"), (8, "x" * 150_000, "en", "c"), (9, ("long text here " * 20_000), "en", "c"),
        (None, "no id here at all, but some text to look at", "en", "a"), (10, "日本語のテキスト、句読点。", "ja", "d"), (11, "\x00\x01 control \x85 signs   and ퟿", "en", "d"),
    ]
    return make(spark, rows).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (None, 1, 0), (5, None, 0), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, " ".join(f"WORD{i % 97}x{i % 13}" for i in range(10, 40))), (4, "one two")], "item_id long, text string")
