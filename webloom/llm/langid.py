"""Language identification with language-bitmask n-gram filters.

Each slot of a bit-sliced Bloom filter holds one bit a language. The AND of an n-gram's slots gives, in one look-up,
all languages that contain the n-gram. A text's n-grams are looked up; per language the set bits are counted and
corrected for that language's false-positive rate, f = fill ** hashes: (count - n f) / (1 - f). The language with the
largest corrected count decides, the score is its share of n.

N-grams are letter trigrams of the lower-cased text, packed exactly into 63 bits, with the edge of a word as a sign
of its own; all work on them is numpy over whole Arrow batches. The filter is fitted on a bounded sample: about
``per_language`` training documents of each language, drawn by hash (documented bound of the classifier). It is
fitted on text and lang of training documents alone, and predictions read nothing but the text.

Edge cases: a null or empty text or one without a letter gives ``und`` with score 0; without training documents every text
is ``und``; very long texts are read whole, in chunks; ties go to the first language in code-point order; more than 64
languages take more mask words a slot; repeated rows are judged row by row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core

PER_LANGUAGE = 3_000
SLOT_BITS = 21
#: Odd multipliers of the hash functions.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: An n-gram belongs to a language if it makes up at least this share of its n-grams, and at least RATIO of its
#: largest share in any language.
MIN_SHARE = 1e-6
RATIO = 0.15
#: Characters handled at once: bounds the memory of a worker, whatever the lengths of the texts.
CHUNK = 1 << 20
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 for all else."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)
    return _LETTERS


def grams(text: str) -> tuple[np.ndarray, int]:
    """Trigram keys around every letter of a lower-cased text (uint64), and the number of letters."""
    codes = _letters()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    middle = codes[1:-1]
    keys = (codes[:-2] << np.uint64(42)) | (middle << np.uint64(21)) | codes[2:]
    return keys, middle


def pieces(texts: list[str | None]):
    """(index, part) of lower-cased texts, each at most CHUNK characters; parts of a text overlap by nothing but words."""
    for i, text in enumerate(texts):
        low = (text or "").lower()
        at = 0
        while at < len(low):
            end = min(len(low), at + CHUNK)
            if end < len(low) and (cut := low.rfind(" ", at + 1, end)) > 0:
                end = cut
            yield i, low[at:end]
            at = end


def joined(texts: list[str | None]):
    """Batches of parts: (indices, one string, starts, ends) with about CHUNK characters each."""
    ids, parts, size = [], [], 0
    for i, part in pieces(texts):
        if size and size + len(part) > CHUNK:
            yield _pack(ids, parts)
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(part)
        size += len(part) + 1
    if ids:
        yield _pack(ids, parts)


def _pack(ids: list[int], parts: list[str]):
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    return np.array(ids), " ".join(parts), ends - lengths, ends


class MaskFilter:
    """The bit-sliced Bloom filter: slots x mask words of up to 64 languages."""

    def __init__(self, languages: list[str], keys: list[np.ndarray], slot_bits: int = SLOT_BITS):
        self.languages = languages
        self.shift = np.uint64(64 - slot_bits)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 if kind is np.uint8 else 64
        self.table = np.zeros((-(-max(1, len(languages)) // width), 1 << slot_bits), kind)
        self.width, self.false = width, []
        for n, own in enumerate(keys):
            bit = kind(1 << (n % width))
            for h in HASHES:
                self.table[n // width, self.slots(own, h)] |= bit
            fill = np.count_nonzero(self.table[n // width] & bit) / (1 << slot_bits)
            self.false.append(fill ** len(HASHES))

    def slots(self, keys: np.ndarray, multiplier: int) -> np.ndarray:
        mixed = keys * np.uint64(multiplier)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """All languages of each key, a mask word a row."""
        out = self.table[:, self.slots(keys, HASHES[0])]
        for h in HASHES[1:]:
            out &= self.table[:, self.slots(keys, h)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hits = np.zeros((len(self.languages), len(texts)))
        total = np.zeros(len(texts))
        for ids, text, starts, ends in joined(texts):
            keys, middle = grams(text)
            letters = middle > 0
            before = np.concatenate([[0], np.cumsum(letters)])
            a, b = before[starts], before[ends]
            np.add.at(total, ids, b - a)
            masks = self.masks(keys[letters])
            for n in range(len(self.languages)):
                set_bits = np.concatenate([[0], np.cumsum((masks[n // self.width] >> masks.dtype.type(n % self.width)) & masks.dtype.type(1), dtype=np.int64)])
                np.add.at(hits[n], ids, set_bits[b] - set_bits[a])
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        f = np.array(self.false)[:, None]
        share = np.clip((hits - total * f) / (1 - f) / np.maximum(total, 1), 0.0, 1.0)
        best = share.argmax(axis=0)
        known = total > 0
        return (
            [self.languages[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)],
            [float(share[j, i]) if k else 0.0 for i, (j, k) in enumerate(zip(best, known, strict=True))],
        )


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> MaskFilter:
    """The filter from a hash sample of about ``per_language`` distinct training texts of each language, whatever their ids and copies."""
    rows = training(core(docs, "doc_id", "text", "lang")).select("lang", "text", F.xxhash64("text").alias("h"))
    found = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    languages = sorted(found)
    if len(languages) > 4096:
        raise ValueError("more than 4096 values of lang: not a language column")
    if not languages:
        return MaskFilter([], [])
    scale = 1 << 30
    most = F.create_map(*(x for n, lang in enumerate(languages) for x in (F.lit(lang), F.lit(min(scale, scale * per_language // found[lang])))))
    sample = rows.filter(F.pmod("h", F.lit(scale)) < most[F.col("lang")]).dropDuplicates(["lang", "h"])
    index = {lang: n for n, lang in enumerate(languages)}

    def run(batch: pa.RecordBatch) -> dict:
        langs, keys, counts = [], [], []
        texts, of = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in sorted(set(of)):
            for _, text, _, _ in joined([t for t, x in zip(texts, of, strict=True) if x == lang]):
                own, middle = grams(text)
                k, c = np.unique(own[middle > 0], return_counts=True)
                langs.append(np.full(len(k), index[lang]))
                keys.append(k.astype(np.int64))
                counts.append(c)
        if not keys:
            return {"lang": [], "key": [], "n": []}
        return {"lang": np.concatenate(langs), "key": np.concatenate(keys), "n": np.concatenate(counts)}

    grammed = arrow_map(sample.select("text", "lang"), run, "lang int, key long, n long", whole=True).groupBy("lang", "key").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    total = grammed.groupby("lang")["n"].sum()
    grammed["share"] = grammed["n"] / grammed["lang"].map(total)
    top = grammed.groupby("key")["share"].transform("max")
    grammed = grammed[(grammed["share"] >= MIN_SHARE) & (grammed["share"] >= RATIO * top)]
    return MaskFilter(languages, [grammed.loc[grammed["lang"] == n, "key"].to_numpy().astype(np.uint64) for n in range(len(languages))])


def identify(docs: DataFrame, model: MaskFilter | None = None) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = shared.value.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

    rows = core(docs, "doc_id", "text").withColumn("held_out", held_out())
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


__all__ = ["MaskFilter", "fit", "identify"]
