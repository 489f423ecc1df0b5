"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles. Equal sets are one class, represented once. MinHash bands propose
candidates: sets that share a band's bucket. Inside a bucket, pairs are compared on their MinHash values, 16 at a time:
under a uniform prior on the similarity, a pair is dropped as soon as the posterior probability of reaching the
threshold falls below ``tolerance``. Only eight bits of each value travel so far, no sets; two that are equal by chance
only let a pair live on. Pairs that survive tie their members into clusters, and a bucket whose members are tied already
has nothing left to compare. The sets of clusters alone are then sent together, and all their pairs verified: by
the same pruning first, exactly on the sets then.

Buckets and clusters of any size are cut into blocks, and every pair of blocks is one task, so no group is ever gathered
whole. A task emits, per member, the number of its links and the few links that connect its members, never all its pairs.
With 32 bands of 5 values a pair at the threshold is missed with probability (1 - 0.8 ** 5) ** 32 < 4e-6.

Edge cases: a text of one to four words is one shingle; null texts and texts without words are classes of their own
without links; very long texts keep all their shingles; repeated rows are copies of each other; ties go to the least
doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core, released, text_digest, written
from webloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-6
#: Documents of a block: a task holds two blocks at most.
BLOCK = 256
#: Members of a bucket that are compared in one task, and rows that a task of many small buckets should hold.
BUCKET_BLOCK, BUCKET_ROWS = 2048, 20_000

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MULT = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, WORDS)]


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    codes = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = digest(w)
        codes.append(c)
    x = np.array(codes, np.uint64)
    if len(x) < size:
        return np.array([digest(x.tobytes())], np.uint64)
    n = len(x) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += x[i : i + n] * np.uint64(_MULT[i % len(_MULT)])
        total ^= total >> np.uint64(31)
    return np.unique(total)


def minhash(hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """BANDS * ROWS MinHash values (uint32) of a non-empty set."""
    low = ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), chunk):
        np.minimum(best, (low[i : i + chunk, None] * _A + _B).min(axis=0), out=best)
    return best


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, most: int = BANDS * ROWS) -> dict[int, int]:
    """n compared -> least matches with P(similarity >= threshold | matches) >= tolerance, for a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), so that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(step, most + 1, step):
        cdf = 0.0
        for m in range(n + 1):
            cdf += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if cdf >= tolerance:
                out[n] = m
                break
    return out


def _band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def _bytes_of(sig: np.ndarray) -> np.ndarray:
    """Eight bits of each MinHash value."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def signatures(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, digest of its text, node (128-bit digest of its shingle set; null without words), its size, bands and
    sig (BANDS * ROWS bytes)."""

    def run(batch: pa.RecordBatch) -> dict:
        nodes, sizes, bands, sigs = [], [], [], []
        for text in batch.column("text").to_pylist():
            own = shingles(text)
            sig = minhash(own) if len(own) else None
            nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sizes.append(len(own))
            bands.append(_band_keys(sig) if len(own) else None)
            sigs.append(_bytes_of(sig).tobytes() if len(own) else None)
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "node": nodes, "size": sizes, "bands": bands, "sig": sigs}

    rows = core(docs, "doc_id", "text").withColumn("digest", text_digest())
    return arrow_map(rows, run, "doc_id long, digest string, node binary, size long, bands array<long>, sig binary")


def _alive(sigs: np.ndarray, sizes: np.ndarray, i: int, js: np.ndarray, threshold: float, least: dict[int, int]) -> np.ndarray:
    """Those of ``js`` that may reach the threshold with i: by length, then by MinHash values, a step at a time."""
    js = js[np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i]) - 1e-9]
    matches, done = np.zeros(len(js), np.int64), 0
    for n, fewest in least.items():
        if not len(js):
            break
        matches = matches + (sigs[js, done:n] == sigs[i, done:n]).sum(axis=1)
        alive = matches >= fewest
        js, matches, done = js[alive], matches[alive], n
    return js


def _ties_of(pdf: pd.DataFrame, threshold: float, least: dict[int, int]) -> pd.DataFrame:
    """One task of buckets: the few pairs (a, b) that tie the members of each bucket which survive the pruning."""
    out_a, out_b = [], []
    pdf = pdf.sort_values(["key", "i", "j", "short"])
    short, sizes, side = pdf["short"].to_numpy(), pdf["size"].to_numpy(), pdf["block"].to_numpy()
    sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    keys = pdf[["key", "i", "j"]].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
    last = max(least)
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        if end - at == 2:  # most buckets
            few, many = sorted((sizes[at], sizes[at + 1]))
            if few >= threshold * many - 1e-9 and (sigs[at] == sigs[at + 1]).sum() >= least[last]:
                out_a.append(short[at])
                out_b.append(short[at + 1])
            continue
        i, j = keys[at, 1], keys[at, 2]
        left = at + np.flatnonzero(side[at:end] == i)
        right = left if i == j else at + np.flatnonzero(side[at:end] == j)
        label = np.arange(at, end)
        for k, a in enumerate(left):
            js = right[k + 1 :] if i == j else right
            js = js[label[js - at] != label[a - at]]
            for b in _alive(sigs, sizes, a, js, threshold, least):
                if label[b - at] != label[a - at]:
                    label[label == label[b - at]] = label[a - at]
                    out_a.append(short[a])
                    out_b.append(short[b])
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def candidate_ties(classes: DataFrame, threshold: float, least: dict[int, int], block: int = BUCKET_BLOCK) -> DataFrame:
    """classes (short, size, bands, sig), written -> (a, b): ties between sets that share a bucket and survive the pruning."""
    keyed = classes.select("short", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("short").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    # Bands that hold the same members are one bucket.
    buckets = buckets.groupBy("n", "who").agg(F.min("key").alias("key"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    buckets = written(buckets.select("key", "n", "blocks"), "op8-buckets")
    rows = buckets.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-rows // BUCKET_ROWS))
    placed = written(keyed.join(buckets, "key").drop("n"), "op8-members")
    members = placed.join(classes.select("short", "size", "sig"), "short")
    own = F.pmod(F.xxhash64("short"), F.col("blocks")).cast("int")
    spread = members.withColumn("block", own).withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "i", "j"))
    found = spread.withColumn("task", task).groupBy("task").applyInPandas(lambda pdf: _ties_of(pdf, threshold, least), "a long, b long")
    ties = written(found, "op8-ties")
    released(buckets, placed)
    return ties


def _sets(chosen: DataFrame) -> DataFrame:
    """chosen: text, node, comp, blocks, copies -> node, comp, blocks, copies, hashes, sig; rows whose text isn't the node's drop out."""

    def run(batch: pa.RecordBatch) -> dict | None:
        keep, hashes, sigs = [], [], []
        for i, (text, node) in enumerate(zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True)):
            own = shingles(text)
            if len(own) and xxhash.xxh3_128_digest(own.tobytes()) == node:
                keep.append(i)
                hashes.append(own.tobytes())
                sigs.append(_bytes_of(minhash(own)).tobytes())
        if not keep:
            return None
        picked = batch.take(pa.array(keep))
        return {n: picked.column(n) for n in ("node", "comp", "blocks", "copies")} | {"hashes": hashes, "sig": sigs}

    return arrow_map(chosen, run, "node binary, comp long, blocks int, copies long, hashes binary, sig binary").dropDuplicates(["node"])


def verified_links(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: dict[int, int]):
    """Yield (i, indices of its partners): pairs of ``left`` x ``right`` (or i < j, if the same) that reach the threshold."""
    every = np.concatenate(sets)
    ids, inverse = np.unique(every, return_inverse=True)
    inverse = inverse.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(ids), np.int64)
    same = left is right
    for at, i in enumerate(left):
        js = _alive(sigs, sizes, i, right[at + 1 :] if same else right, threshold, least)
        if not len(js):
            continue
        own = inverse[starts[i] : starts[i + 1]]
        mark[own] = 1
        lengths = sizes[js]
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.arange(lengths.sum()) + np.repeat(starts[js] - offsets, lengths)
        common = np.add.reduceat(mark[inverse[flat]], offsets)
        mark[own] = 0
        found = js[common >= threshold * (sizes[i] + lengths - common) - 1e-9]
        if len(found):
            yield i, found


def _links_of(pdf: pd.DataFrame, threshold: float, least: dict[int, int]) -> pd.DataFrame:
    """One task: (node, links) of its members and (node, mate) rows that connect them."""
    nodes, mates, links = [], [], []
    for _, part in pdf.groupby(["comp", "i", "j"], sort=False):
        part = part.sort_values("node").reset_index(drop=True)
        sigs = np.stack([np.frombuffer(x, np.uint8) for x in part["sig"]])
        sets = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
        copies = part["copies"].to_numpy()
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        side = part["block"].to_numpy()
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        count, label = np.zeros(len(part), np.int64), np.arange(len(part))
        for a, found in verified_links(sigs, sets, left, right, threshold, least):
            count[a] += copies[found].sum()
            count[found] += copies[a]
            for b in found[label[found] != label[a]]:
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    nodes.append(part["node"][a])
                    mates.append(part["node"][b])
                    links.append(0)
        for k in np.flatnonzero(count):
            nodes.append(part["node"][k])
            mates.append(None)
            links.append(int(count[k]))
    return pd.DataFrame({"node": pd.Series(nodes, dtype=object), "mate": pd.Series(mates, dtype=object), "links": pd.Series(links, dtype="int64")})


def _judged(docs: DataFrame, threshold: float, tolerance: float, block: int, bucket_block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named): rows (doc_id, digest of the text, node) for every document row, named (node, root, copy_id, class_id, n_links)
    for every distinct set. Texts are fetched again by their digests, so that no id of a row has to be the same twice."""
    least = fewest_matches(threshold, tolerance)
    signed = written(signatures(docs), "op8-signed")
    rows = written(signed.select("doc_id", "digest", "node"), "op8-rows")
    classes = signed.filter("node IS NOT NULL").groupBy("node")
    classes = classes.agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("digest", "size", "bands", "sig")).alias("one"))
    # Candidates are tied by 64 bits of their digests: where two meet by chance, only one more pair is compared.
    classes = written(classes.select("node", F.xxhash64("node").alias("short"), "copy_id", "copies", "one.*"), "op8-nodes")
    released(signed)
    ties = candidate_ties(classes, threshold, least, bucket_block)
    roots = written(components(ties), "op8-roots")
    sizes = written(roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "op8-sizes")
    members = roots.join(sizes, "root").select(F.col("node").alias("short"), F.col("root").alias("comp"), "blocks")
    chosen = members.join(classes.select("node", "digest", "copies", "short"), "short").drop("short")
    texts = core(docs, "text").withColumn("digest", text_digest()).join(chosen, "digest").select("text", "node", "comp", "blocks", "copies")
    sets = written(_sets(texts), "op8-sets")
    n_small = sets.filter("blocks = 1").count()
    bins = max(1, -(-n_small // block))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = sets.withColumn("block", own).withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.xxhash64("comp", "i", "j"))
    found = written(
        spread.withColumn("task", task).groupBy("task").applyInPandas(lambda pdf: _links_of(pdf, threshold, least), "node binary, mate binary, links long"), "op8-links"
    )
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("mate IS NOT NULL").select(F.col("node").alias("a"), F.col("mate").alias("b")))
    # A class takes the least doc_id of its members.
    placed = classes.select("node", "copy_id", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "op8-placed")
    names = written(placed.groupBy("root").agg(F.min("copy_id").alias("class_id")), "op8-classes")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = written(placed.join(names, "root").join(linked, "node", "left").select("node", "root", "copy_id", "class_id", links), "op8-named")
    released(classes, ties, roots, sizes, sets, found, placed, names)
    return rows, named


def jaccard_classes(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, bucket_block: int = BUCKET_BLOCK
) -> DataFrame:
    """Per document row: doc_id, class_id (least doc_id linked to it over any chain), copy_id (least doc_id with an equal
    shingle set), n_links (other documents at the threshold or above, equal ones included)."""
    rows, named = _judged(docs, threshold, tolerance, block, bucket_block)
    lone = F.col("node").isNull()
    return rows.join(named, "node", "left").select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, bucket_block: int = BUCKET_BLOCK
) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (null ones last), ties by the text's digest.

    A class is known by its sets and a row by its doc_id and text, so doc_id may be null or name several rows; of rows equal
    in both any one stays. Rows without words are classes of their own.
    """
    rows, named = _judged(docs, threshold, tolerance, block, bucket_block)
    worded = rows.filter("node IS NOT NULL").join(named.select("node", "root"), "node")
    best = worded.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")).alias("best"))
    best = written(best.select(F.col("best.doc_id").alias("__webloom_id"), F.col("best.digest").alias("__webloom_digest")), "op8-best")
    released(rows, named)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.filter(has_words).withColumn("__webloom_own", text_digest())
    kept = own.join(best, (F.col("__webloom_own") == F.col("__webloom_digest")) & F.col("doc_id").eqNullSafe(F.col("__webloom_id")))
    kept = kept.dropDuplicates(["__webloom_own", "__webloom_id"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(docs.filter(~has_words))


__all__ = ["fewest_matches", "jaccard_classes", "keep_one_of_each", "minhash", "shingles"]
