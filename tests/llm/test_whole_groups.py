"""A passage that many documents share is never gathered in one group."""

import random

from tests.llm.conftest import make
from tests.llm.test_operators import brute_repeats
from webloom.llm import suffix_dedup


def test_blocks_of_a_widely_shared_passage_are_sorted_once(spark, monkeypatch):
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = piece(900)
    texts = {i: piece(300) + passage + piece(300) for i in range(20)}
    sort_task = suffix_dedup._sort_task

    def watched(pdf):
        assert not pdf.duplicated(["key", "data"]).any(), "equal blocks"
        assert pdf.groupby("key").size().max() <= 3, "a crowded key"
        return sort_task(pdf)

    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "_sort_task", watched)
    docs = make(spark, [(k, t, "en", "s") for k, t in texts.items()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(texts)
