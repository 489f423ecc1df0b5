"""Byte-level BPE against the tokenizer library and against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from webloom.llm import bpe
from webloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocab():
    return bpe.read_vocabulary(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(11)
    alphabet = "aábc AB'sll  \n\t12é日本語🙂 \x85\x1c\x00!?<|endoftext|>"
    yield from ("", " ", "\n\n  x", "don't we'll I'M", "a" * 2_000, "日本" * 900, "🙂" * 300 + "x", " " * 5_000 + "y", "<|endoftext|>", "ab" * 40_000)
    for _ in range(300):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))


def test_texts_match_the_library(vocab, library):
    texts = list(odd_texts())
    flat, sizes = bpe.encode_texts([*texts, None], vocab)
    at = 0
    for text, n in zip(texts, sizes):
        assert flat[at : at + n].tolist() == library.encode_ordinary(text), repr(text[:60])
        at += n
    assert sizes[-1] == 0


def test_rows_and_heap_merge_alike(vocab, library):
    rng = random.Random(12)
    for _ in range(200):
        piece = bytes(rng.choice(b"aeinst rol\xc3\xa9") for _ in range(rng.randint(2, 300)))
        want = library._core_bpe.encode_single_piece(piece)
        if piece in vocab.ranks:
            continue
        ids = np.full((1, len(piece) + 3), -1, np.int32)
        ids[0, : len(piece)] = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
        assert bpe.merge_rows(ids, vocab.pairs)[2].tolist() == want == bpe.merge_long(piece, vocab).tolist()


def test_blocks_of_a_long_text_join(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "CELLS", 30)
    text = "some words that are cut into several blocks, unhyphenatedly xqzjvk 123456 " * 5
    flat, sizes = bpe.encode_texts([text, "x"], vocab)
    assert flat[: sizes[0]].tolist() == library.encode_ordinary(text)


def test_query_on_whole_table(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, spark):
    back = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH, PATTERN).collect()
    want = sorted(((r["doc_id"] or 0, (r["text"] or "").encode()) for r in odd_docs.collect()))
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in back) == want
    assert bpe.encode(no_docs, PATH, PATTERN).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(none, PATH, PATTERN).orderBy("doc_id").collect()] == [b"", b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), PATH, PATTERN).collect()


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="lacks"):
        bpe.Vocabulary({bytes([b]): b for b in range(255)}, PATTERN)
