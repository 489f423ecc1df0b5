"""Disguises and prose that looks like them."""

import pytest

from webloom.llm import pii


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.find_spans(text)[1]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to ann@example。com today", [("email", "ann@example。com")]), ("ann@mail。example。com", [("email", "ann@mail。example。com")]), ("host 10。20。30。40 is up", [("ip", "10。20。30。40")]),
        ("mail аnn@example.com now", [("email", "аnn@example.com")]), ("mail ann@example.cоm now", [("email", "ann@example.cоm")]), ("write to john at example dot com", [("email", "john at example dot com")]),
        ("192 dot 168 dot 0 dot 7 is the host", [("ip", "192 dot 168 dot 0 dot 7")]),
    ],
)
def test_disguises_are_found(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "we sell at amazon dot de today", "they shop at example dot com", "5 point 5 point 5 point 5 percent", "five point five point five point five per cent",
        "ann@example.com。Please reply", "ann@example.com。请回复", "call +44 20 7946 0958 five times", "It ends here。com is a word", "", "。", "a。", "。com",
    ],
)
def test_prose_is_left_alone(text):
    assert found(text) == []


def test_base_spans_stay_and_no_letter_is_left(spark):
    text = "mail аnn@example.com or bob@example.org"
    base, added = pii.find_spans(text)
    assert [text[a:b] for _, a, b in base] == ["nn@example.com", "bob@example.org"] and [text[a:b] for _, a, b in added] == ["аnn@example.com"]
    d = spark.createDataFrame([(1, text), (2, "x ann@example.cоm y"), (3, None), (4, "")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(d).orderBy("doc_id").collect()] == ["mail <email> or <email>", "x <email> y", None, ""]
