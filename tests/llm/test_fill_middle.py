"""Fill-in-middle against plain slicing, and exact round trips."""

import hashlib
import random
import re

import pytest

from tests.llm.conftest import make
from webloom.llm import fill_middle
from webloom.llm.fill_middle import balanced, leaves_of, rearranged, restored, split, text_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(rng, n):
    return "".join(rng.choice(["a", "bc", "日本", "<", "<P", ">", "P>", " ", "  ", "\n", "\t", " ", "\x0b"]) for _ in range(n))


def test_ropes_split_at_every_rank():
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 1500):
        text = random_text(rng, n)
        units = UNIT.findall(text)
        rope = balanced(leaves_of(text))
        assert (rope.units, rope.chars, text_of(rope)) == (len(units), len(text), text)
        for k in {0, 1, len(units) // 2, 255, 256, 257, len(units) - 1, len(units)}:
            if 0 <= k <= len(units):
                a, b = split(rope, k)
                assert (a.units, text_of(a), text_of(b)) == (k, "".join(units[:k]), "".join(units[k:]))


@pytest.mark.parametrize("h3", [0, 90])
def test_round_trip_of_random_texts(h3):
    rng = random.Random(2)
    for _ in range(500):
        text = random_text(rng, rng.randint(0, 900))
        h = rng.randrange(1 << 32), rng.randrange(1 << 32), h3, rng.randrange(100)
        n, form, _, _, out = rearranged(text, h, 50, 80, fill_middle.SENTINELS)
        assert restored(out, form, fill_middle.SENTINELS) == text and n == len(UNIT.findall(text))


def test_rows_match_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: plain_version(r["doc_id"], r["text"] or "") for r in docs.collect()}
    got = fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()
    assert {r["doc_id"]: tuple(r[1:6]) for r in got} == want
    assert {r["doc_id"]: r["restored"] for r in got} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {f for _, f, *_ in want.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, no_docs):
    got = fill_middle.restore(fill_middle.fill_in_middle(odd_docs)).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=key)
    assert sorted(tuple(r[1:6]) for r in got if r["doc_id"] in (None, 1, 6)) == sorted(plain_version(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] in (None, 1, 6))
    assert fill_middle.fill_in_middle(no_docs).collect() == []
    marked = make(spark, [(i, f"words <M> more {i}", "en", "a") for i in range(20)])
    assert {r["form"] for r in fill_middle.fill_in_middle(marked, rate=100).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd_docs, sentinels=("<P>", "<P>", "<M>"))
