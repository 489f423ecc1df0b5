"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A document contains a window
only if it contains the window's rarest word, so for containment 1.0 the necessary prefix of a window is that single
word, in the global order by document frequency over the whole corpus. Document words that are some window's prefix
word become candidates with the words around them; the position of the prefix word in the window bounds where the
window can lie in the document (positional and length bounds), and the words before and after it are then compared exactly.

Words reach the join only if the benchmark's prefix words hold them, and its prefix pairs hold them with the next word.
Up to MOST_WORDS words are sent to the tasks as they are; a larger vocabulary as a bit map of hashed words, sized by it
and capped (``max_bits``), which at worst lets more words through to the join, which decides. The windows themselves are joined, not broadcast, so the benchmark can grow as well.

Edge cases: null or empty texts and items have no words, are never hit and hit nothing; very long texts are read whole;
an item of 1 to 12 words is one window; ties between equally rare words go to the least word, then its first place;
repeated items with one id count once; repeated document rows are judged row by row; empty tables give no hits; extra
columns are ignored by :func:`contamination` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations


from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core, text_digest, written

SIZE = 13
#: Words up to which a vocabulary is sent to the tasks as it is.
MOST_WORDS = 200_000
#: Bytes of the bit map that travel to the driver as one row.
BITMAP_BLOCK = 1 << 16
#: Bytes that are no part of a word become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = SIZE) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def _slot(word: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(word) & (bits - 1)


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item_id, words) of all windows of all items."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, found = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in {tuple(w) for w in windows_of(words_of(text), size)}:
                ids.append(item)
                found.append([x.decode("utf-8", "surrogatepass") for x in w])
        return {"item_id": ids, "words": found}

    items = core(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("string"))
    return arrow_map(items, run, "item_id string, words array<string>").distinct()


def bitmap(words: DataFrame, max_bits: int = 1 << 28) -> np.ndarray:
    """A bit per hashed word; ``words`` has one column ``word``. Sixteen bits a word, at most ``max_bits``."""
    n = words.count()
    bits = 1 << max(10, min(max_bits.bit_length() - 1, int(16 * max(1, n)).bit_length()))

    def run(batch: pa.RecordBatch) -> dict:
        slots = np.unique(np.fromiter((_slot(w.encode("utf-8", "surrogatepass"), bits) for w in batch.column("word").to_pylist()), np.int64, batch.num_rows))
        return {"byte": slots >> 3, "bit": (1 << (slots & 7)).astype(np.int64)}

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(BITMAP_BLOCK, np.uint8)
        np.bitwise_or.at(own, pdf["byte"].to_numpy() % BITMAP_BLOCK, pdf["bit"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"block": [key[0]], "data": [own.tobytes()]})

    bytes_ = arrow_map(words, run, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    packed = bytes_.groupBy(F.expr(f"byte DIV {BITMAP_BLOCK}").alias("block")).applyInPandas(block, "block long, data binary")
    out = np.zeros(-(-(bits >> 3) // BITMAP_BLOCK) * BITMAP_BLOCK, np.uint8)
    for r in packed.toLocalIterator():  # max_bits / 8 bytes at most, in blocks
        out[r["block"] * BITMAP_BLOCK : (r["block"] + 1) * BITMAP_BLOCK] = np.frombuffer(r["data"], np.uint8)
    return out[: bits >> 3]


def _has(table: np.ndarray, word: bytes) -> bool:
    s = _slot(word, len(table) << 3)
    return bool(table[s >> 3] >> (s & 7) & 1)


class Vocabulary:
    """Membership of words: the words themselves up to ``MOST_WORDS`` of them, beyond that a bit map that may let others through."""

    def __init__(self, words: DataFrame):
        few = [r["word"] for r in words.limit(MOST_WORDS + 1).collect()]
        self.words = frozenset(w.encode("utf-8", "surrogatepass") for w in few) if len(few) <= MOST_WORDS else None
        self.table = bitmap(words) if self.words is None else None
        self.known: dict[bytes, bool] = {}

    def of(self, words: set[bytes]) -> set[bytes]:
        """Those of ``words`` that are in it; answers of the bit map are remembered, and forgotten when there are many."""
        if self.words is not None:
            return words & self.words
        if len(self.known) > 200_000:
            self.known.clear()
        hits = set()
        for w in words:
            hit = self.known.get(w)
            if hit is None:
                hit = self.known[w] = _has(self.table, w)
            if hit:
                hits.add(w)
        return hits

    def __contains__(self, word: bytes) -> bool:
        return word in self.words if self.words is not None else _has(self.table, word)


def document_frequency(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, df) over all documents for the words of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        counts: Counter[bytes] = Counter()
        known = shared.value
        for text in batch.column("text").to_pylist():
            counts.update(known.of(set(words_of(text))))
        return {"word": [w.decode("utf-8", "surrogatepass") for w in counts], "df": list(counts.values())}

    return arrow_map(core(docs, "text"), run, "word string, df long", whole=True).groupBy("word").agg(F.sum("df").alias("df"))


def prefixes(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each window with its rarest word (``token``; ties by the word, then the first place), the words before and after it
    (``pre``, ``post``; joined by spaces) and the ``sign`` of the token and its neighbour."""
    placed = windows.withColumn("wid", F.xxhash64("item_id", "words")).select("wid", "item_id", "words", F.posexplode("words").alias("off", "token"))
    rare = placed.join(frequency, F.col("token") == F.col("word"), "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = rare.groupBy("wid", "item_id", "words").agg(F.min(F.struct("df", "token", "off")).alias("first"))
    n, off = F.size("words"), F.col("off")
    out = first.select("item_id", "words", n.alias("len"), "first.token", "first.off")
    after, before = F.element_at("words", F.least(off + 2, n)), F.element_at("words", F.greatest(off, F.lit(1)))
    sign = F.when(off + 1 < n, F.concat_ws(" ", "token", after)).when(off > 0, F.concat_ws(" ", before, "token", F.lit(""))).otherwise(F.col("token"))
    return out.select(
        "item_id", "len", "token", "off", sign.alias("sign"),
        F.array_join(F.slice("words", F.lit(1), off), " ").alias("pre"),
        F.array_join(F.slice("words", off + 2, n), " ").alias("post"),
    )


def _places(words: list[bytes], hits: set[bytes]) -> list[int]:
    """Where in ``words`` the hits are, in order."""
    if len(hits) > 6:
        return [i for i, w in enumerate(words) if w in hits]
    out = []
    for w in hits:
        i = -1
        try:
            while True:
                i = words.index(w, i + 1)
                out.append(i)
        except ValueError:
            pass
    return sorted(out)


def candidates(docs: DataFrame, tokens: Vocabulary, signs: Vocabulary, size: int = SIZE) -> DataFrame:
    """Per document row the digest of its text, its word count and, for each word that may be a prefix word beside its neighbour, the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, signs))

    def run(batch: pa.RecordBatch) -> dict:
        known, pairs = shared.value
        n_words, found = [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            n = len(words)
            n_words.append(n)
            own = []
            for i in _places(words, known.of(set(words))):
                w = words[i]
                if (i + 1 < n and w + b" " + words[i + 1] in pairs) or (i and words[i - 1] + b" " + w + b" " in pairs) or w in pairs:
                    left = words[max(0, i - size + 1) : i]
                    right = words[i + 1 : i + size]
                    own.append(
                        {
                            "pos": i,
                            "n_left": len(left),
                            "n_right": len(right),
                            "token": w.decode("utf-8", "surrogatepass"),
                            "left": b" ".join(left).decode("utf-8", "surrogatepass"),
                            "right": b" ".join(right).decode("utf-8", "surrogatepass"),
                        }
                    )
            found.append(own)
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_words": n_words, "found": found}

    schema = "doc_id long, digest string, n_words long, found array<struct<pos:int,n_left:int,n_right:int,token:string,left:string,right:string>>"
    return arrow_map(core(docs, "doc_id", "text").withColumn("digest", text_digest()), run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    return _judged(docs, benchmark, size).drop("digest")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """:func:`contamination` with the digest of each row's text."""
    windows = written(benchmark_windows(benchmark, size), "op4-windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    frequency = written(document_frequency(docs, Vocabulary(vocabulary)), "op4-frequency")
    prefix = written(prefixes(windows, frequency), "op4-prefixes")
    tokens, signs = (Vocabulary(prefix.select(F.col(c).alias("word")).distinct()) for c in ("token", "sign"))
    rows = written(candidates(docs, tokens, signs, size).withColumn("rid", F.monotonically_increasing_id()), "op4-rows")
    each = rows.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    fits = (F.col("off") <= F.col("n_left")) & (F.col("len") - F.col("off") - 1 <= F.col("n_right"))  # positional and length bounds
    before = (F.col("pre") == "") | F.endswith(F.concat(F.lit(" "), "left"), F.concat(F.lit(" "), "pre"))
    after = (F.col("post") == "") | F.startswith(F.concat("right", F.lit(" ")), F.concat("post", F.lit(" ")))
    hits = each.join(prefix, "token").filter(fits & before & after).select("rid", "item_id", (F.col("pos") - F.col("off")).alias("start"), "len")
    # The union of the hit runs: each run counts what lies beyond all runs that start before it.
    runs = hits.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    covered = runs.select("rid", gain.alias("gain")).groupBy("rid").agg(F.sum("gain").alias("n_hit"))
    items = hits.groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (
        rows.select("rid", "doc_id", "digest", "n_words")
        .join(covered, "rid", "left")
        .join(items, "rid", "left")
        .select(
            "doc_id",
            "digest",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        )
        .withColumn("n_items", F.greatest("n_items", F.lit(0)))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, each judged by its own text whatever its ``doc_id``."""
    bad = written(_judged(docs, benchmark, SIZE).filter("contaminated").select(F.col("digest").alias("__webloom_bad")).distinct(), "op4-bad")
    return docs.join(bad, text_digest() == F.col("__webloom_bad"), "left_anti")


__all__ = ["contamination", "drop_contaminated"]
