"""Removal of repeated 200-byte strings with a distributed difference-cover suffix sort.

1. Texts. Equal texts repeat each other whole; what follows works on one copy of each.
2. Anchors. In every 200-byte window the least 50-byte gram (by hash; the rightmost of equals) is the window's
   anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal places: windows whose
   anchor gram occurs once in the corpus can't repeat, and all others meet their equals under one anchor. Consecutive
   windows share anchors, about one in 76 bytes.
3. Contexts. An anchor's windows lie in one stretch of bytes, its context. A context that occurs twice repeats with
   all its windows. Only anchors with several different contexts need a closer look, at one copy of each context.
4. Difference-cover suffix sort. These contexts are dealt into tasks by anchor; each task sorts all its suffixes:
   triples of 8-byte symbols at the positions 1 and 2 modulo 3 are sorted and named, the string of names is sorted by
   recursion (three levels decide 27 symbols, 216 bytes), the remaining suffixes are merged in by symbol and rank,
   and neighbours in the suffix order are compared over exactly 200 bytes.
5. Repeated windows go back to every place where their context occurs, and the bytes they cover are removed.

No group is gathered whole: an anchor with very many contexts is cut further, by place in the window and by the bytes
that a block of eight windows shares; equal blocks meet in a join, and one copy of them is sorted. Texts over PIECE
windows are worked on in overlapping pieces. Texts are told apart by md5, contexts by 128 bits of two hashes.

Edge cases: null texts are empty; texts under 200 bytes keep every byte; very long texts are worked on in pieces that
overlap by a window; repeated rows repeat each other, whatever their ids; ties between equal grams go to the right one;
an empty table gives an empty result; extra columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core, released, text_digest, written

LENGTH, GRAM = 200, 50
SPAN = LENGTH - GRAM + 1
#: Windows of a text, and bytes of texts, that are worked on at once: bounds a worker's arrays.
PIECE, BUFFER = 1 << 18, 1 << 19
#: Bytes that a task's suffix sort should hold, and contexts from which an anchor is cut further.
TASK_BYTES, MANY = 1 << 18, 3000
#: Windows of a block when an anchor is cut further.
BLOCK = 8
SYMBOL, LEVELS = 8, 3

_PLACE_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        have = _powers[base] = tuple(out)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Sums:
    """Hashes of any range of a byte array, by prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = _power_tables(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """For all windows of the pieces: (piece, lo, n, d, h, c), a row for each run of windows with one anchor.

    lo: first window; n: windows after it; d: anchor minus lo; h: hash of the anchor gram; c: hash of the context.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths) - lengths
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = _Sums(data, _BASES[0])
    m = len(data) - GRAM + 1
    gram = _mix((sums.sums[GRAM:] - sums.sums[:m]) * sums.inverse[:m])
    place = np.arange(m, dtype=np.uint64)
    least = (gram & ~_PLACE) | (_PLACE - place)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    counts = np.maximum(lengths - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    at = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([edge[1:], [len(at)]]) - 1
    first, end, p = start[edge], start[last] if len(edge) else edge, at[edge]
    context = _mix(_Sums(data, _BASES[1]).of(first, end + LENGTH) + _mix((p - first).astype(np.uint64) * np.uint64(1 << 20) + (end - first).astype(np.uint64)))
    piece = owner[edge]
    return piece, first - begins[piece], end - first, p - first, gram[p].view(np.int64), context.view(np.int64)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal rows, in the order of the columns."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        return np.unique(_packed(columns, bits), return_inverse=True)[1].reshape(-1) + 1
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _packed(columns, bits) -> np.ndarray:
    key = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key = (key << b) | c
    return key


def _before(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of ``ids`` (small integers) are less than each of ``of``."""
    top = max(int(ids.max()) if len(ids) else 0, int(of.max()) if len(of) else 0)
    counts = np.bincount(ids, minlength=top + 1)
    return (np.cumsum(counts) - counts)[of]


def dc_ranks(x: np.ndarray, levels: int) -> np.ndarray:
    """Order numbers of the suffixes of ``x`` (symbols from 1): by their first 3 ** levels symbols at least.

    Suffixes equal that far may come in any order, but lie together.
    """
    n = len(x)
    if levels == 0 or n < 4:
        return _names(*(np.concatenate([x[k:], np.zeros(min(k, n), np.int64)])[:n] for k in range(min(3, n)))) if 0 < levels and n else x
    t = np.concatenate([x, np.zeros(3, np.int64)])
    # Where n is 1 modulo 3, an empty suffix ends the names of the first residue.
    s1, s2, s0 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([s1, s2])
    inner = dc_ranks(_names(t[sample], t[sample + 1], t[sample + 2]), levels - 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = _names(inner)
    s1 = s1[s1 < n]
    sample = np.concatenate([s1, s2])
    bits = max(int(t.max()), int(rank.max())).bit_length()

    def less(columns_of, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of b come before each of a, and of a before each of b."""
        columns = [np.concatenate(pair) for pair in zip(columns_of(a), columns_of(b), strict=True)]
        ids = np.unique(_packed(columns, [bits] * len(columns)), return_inverse=True)[1].reshape(-1) if bits * len(columns) <= 63 else _names(*columns)
        return _before(ids[len(a) :], ids[: len(a)]), _before(ids[: len(a)], ids[len(a) :])

    one = lambda i: (t[i], rank[i + 1])
    two = lambda i: (t[i], t[i + 1], rank[i + 2])
    before1, s0_before1 = less(one, s0, s1)
    before2, s0_before2 = less(two, s0, s2)
    own = _names(*one(s0))
    out = np.empty(n, np.int64)
    out[s0] = _before(own, own) + before1 + before2
    position = _before(rank[sample], rank[sample])
    out[s1] = position[: len(s1)] + s0_before1
    out[s2] = position[len(s1) :] + s0_before2
    return out + 1


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows (LENGTH bytes of ``data`` from ``starts``) equal another of them; by suffix order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(SYMBOL, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(SYMBOL):
        word = (word << np.uint64(8)) | padded[k : k + n]
    # Suffixes of the text are suffixes of its SYMBOL interleaved strings of 8-byte symbols, laid end to end.
    order = np.concatenate([np.arange(r, n, SYMBOL) for r in range(SYMBOL)])
    symbols = np.unique(word, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    ranks = np.empty(n, np.int64)
    ranks[order] = dc_ranks(symbols[order], LEVELS)
    by = np.argsort(ranks[starts], kind="stable")
    s = starts[by]
    same = np.ones(max(0, len(s) - 1), bool)
    a, b = s[:-1], s[1:]
    live = np.arange(len(same))
    for k in range(0, LENGTH, SYMBOL):  # compare neighbours, eight bytes at a time
        equal = word[a[live] + k] == word[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        if not len(live):
            break
    out = np.zeros(len(starts), bool)
    out[by[:-1][same]] = True
    out[by[1:][same]] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _sort_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Suffix-sort the contexts of a task: (h, c, from, to) for every run of repeated windows, counted from the context's first."""
    pdf = pdf.sort_values(["h", "c", "w0"])
    data = np.frombuffer(b"".join(pdf["data"]), np.uint8)
    lengths = pdf["data"].map(len).to_numpy()
    begins = np.cumsum(lengths) - lengths
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(pdf)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = repeated_windows(data, begins[owner] + inside)
    # Runs may not join two rows: leave a gap between them.
    flags = np.zeros(counts.sum() + len(pdf), bool)
    flags[np.arange(len(hit)) + owner] = hit
    first, last = _runs(flags)
    row = np.searchsorted(np.cumsum(counts + 1), first, side="right")
    base = (np.cumsum(counts + 1) - counts - 1)[row]
    w0 = pdf["w0"].to_numpy()[row]
    return pd.DataFrame({"h": pdf["h"].to_numpy()[row], "c": pdf["c"].to_numpy()[row], "first": first - base + w0, "last": last - base + w0})


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_ANCHOR = "array<struct<lo:int,n:int,d:int,h:long,c:long>>"


def _anchored(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, digest (md5) of its text, bytes, sha256 of all bytes, anchors."""

    def run(batch: pa.RecordBatch) -> dict:
        raw = [_utf8(t) for t in batch.column("text").to_pylist()]
        pieces, of, shift = [], [], []
        for i, b in enumerate(raw):
            for at in range(0, max(1, len(b) - LENGTH + 1), PIECE):
                if len(b) >= LENGTH:
                    pieces.append(b[at : at + PIECE + LENGTH - 1])
                    of.append(i)
                    shift.append(at)
        columns, owners, at = [], [], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BUFFER):
                size += len(pieces[end])
                end += 1
            piece, *rest = anchors(pieces[at:end])
            rest[0] = rest[0] + np.array(shift[at:end], np.int64)[piece] if len(piece) else rest[0]
            owners.append(np.array(of[at:end], np.int64)[piece] if len(piece) else piece)
            columns.append(rest)
            at = end
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        merged = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, np.int64)] * 5
        kinds = (np.int32, np.int32, np.int32, np.int64, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(merged, kinds, strict=True)], names=["lo", "n", "d", "h", "c"])
        return {
            "doc_id": batch.column("doc_id"),
            "digest": [hashlib.md5(b, usedforsecurity=False).hexdigest() for b in raw],
            "n_bytes": list(map(len, raw)),
            "sha": [hashlib.sha256(b).hexdigest() for b in raw],
            "anchors": pa.ListArray.from_arrays(pa.array(offsets), structs),
        }

    return arrow_map(core(docs, "doc_id", "text"), run, f"doc_id long, digest string, n_bytes long, sha string, anchors {_ANCHOR}")


def _contexts(wanted: DataFrame) -> DataFrame:
    """wanted: text, reps (h, c, lo, n, d, many) -> (key, h, c, w0, data) rows for the suffix sort."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"key": [], "h": [], "c": [], "w0": [], "data": []}

        def add(key, r, w0, data):
            for name, value in zip(out, (key, r["h"], r["c"], w0, data), strict=True):
                out[name].append(value)

        for text, reps in zip(*(batch.column(c).to_pylist() for c in ("text", "reps")), strict=True):
            raw = _utf8(text)
            for r in reps:
                lo, n = r["lo"], r["n"]
                if not r["many"]:
                    add(r["h"], r, 0, raw[lo : lo + n + LENGTH])
                    continue
                for block in {(r["d"] - w) // BLOCK for w in range(n + 1)}:  # windows by distance to the anchor
                    a, b = max(0, r["d"] - block * BLOCK - BLOCK + 1), min(n, r["d"] - block * BLOCK)
                    core_from = lo + r["d"] - block * BLOCK
                    shared = raw[core_from : core_from + LENGTH - BLOCK + 1]
                    key = xxhash.xxh3_64_intdigest(shared, seed=block) - (1 << 63)
                    add(key, r, a, raw[lo + a : lo + b + LENGTH])
        return out

    return arrow_map(wanted, run, "key long, h long, c long, w0 int, data binary")


def _met_twice(pieces: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """pieces (key, h, c, w0, data, mark), written -> (runs, pieces): the runs of all windows of pieces whose bytes occur
    several times under one key, and the pieces with one copy of each such piece. Bytes are told apart by 64 bits beside the key."""
    place = F.struct("h", "c", "w0")
    twice = pieces.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("one")).filter("k > 1").drop("k")
    twice = written(twice, tag)
    runs = pieces.select("key", "mark", "h", "c", "w0", F.octet_length("data").alias("size")).join(twice, ["key", "mark"])
    runs = runs.select("h", "c", F.col("w0").alias("first"), (F.col("w0") + F.col("size") - LENGTH).cast("int").alias("last"))
    once = pieces.join(twice, ["key", "mark"], "left").filter(F.col("one").isNull() | (F.col("one") == place)).drop("one")
    return runs, once


def _windows(pieces: DataFrame) -> DataFrame:
    """The single windows of pieces, as pieces keyed by their own bytes."""
    own = F.explode(F.sequence(F.lit(0), F.octet_length("data") - LENGTH)).alias("i")
    each = pieces.select("h", "c", "w0", "data", own).select("h", "c", (F.col("w0") + F.col("i")).cast("int").alias("w0"), F.col("data").substr(F.col("i") + 1, F.lit(LENGTH)).alias("data"))
    return each.select(F.xxhash64(F.lit("window"), "data").alias("key"), "h", "c", "w0", "data", F.xxhash64("data").alias("mark"))


def _cut(rows: DataFrame) -> DataFrame:
    """rows: text, digest, spans -> digest and the result of removing the spans."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"digest": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, digest, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "digest", "spans")), strict=True):
            raw = _utf8(text)
            removed = n = at = 0
            kept = hashlib.sha256()
            end = -1
            for s in sorted((s["a"], s["b"]) for s in spans):
                if s[0] > end:
                    n += 1
                    kept.update(raw[at : s[0]])
                    removed += s[1] - s[0]
                    end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    end = s[1]
                at = end
            kept.update(raw[at:])
            for name, value in zip(out, (digest, removed, n, kept.hexdigest()), strict=True):
                out[name].append(value)
        return out

    return arrow_map(rows, run, "digest string, n_removed long, n_spans long, kept_sha256 string")


def _with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text and the md5 of the text's bytes."""
    return core(docs, "doc_id", "text").withColumn("digest", text_digest())


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): rows (doc_id, digest, n_bytes, sha) for every document row, texts (digest, rid, _id, k) for every
    distinct text with the number of its rows, spans (rid, a, b) to remove from texts that occur once; spans may meet."""
    rows = written(_anchored(docs).withColumn("rid", F.monotonically_increasing_id()), "op6-rows")
    texts = rows.groupBy("digest").agg(F.min(F.struct("rid", F.col("doc_id").alias("_id"))).alias("rep"), F.count(F.lit(1)).alias("k"))
    texts = written(texts.select("digest", "rep.rid", "rep._id", "k"), "op6-texts")
    copies = written(rows.select("digest", "rid").join(texts.filter("k > 1").select("digest", F.col("rid").alias("first")), "digest").filter("rid <> first").select("rid"), "op6-copies")
    each = rows.select("rid", "anchors").join(copies, "rid", "left_anti").select("rid", F.explode("anchors").alias("x")).select("rid", "x.*")
    each = written(each, "op6-anchors")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("k > 1")
    # Written first: a join of two plain shuffles can be split where one gram has very many places.
    twice = written(twice.select("h", (F.col("c0") != F.col("c1")).alias("several")), "op6-twice")
    shared = written(each.join(twice, "h"), "op6-shared")
    released(each, twice)
    contexts = shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.max("several").alias("several"), F.max("n").alias("n"), F.min(F.struct("rid", "lo", "n", "d")).alias("rep"))
    contexts = written(contexts, "op6-contexts")
    whole = contexts.filter("k > 1").select("h", "c", F.lit(0).alias("first"), F.col("n").alias("last"))
    several = contexts.filter("several")
    many = several.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > MANY).select("h", F.lit(True).alias("many"))
    reps = several.join(written(many, "op6-many"), "h", "left").select("h", "c", "rep.*", F.coalesce("many", F.lit(False)).alias("many"))
    by_row = reps.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "lo", "n", "d", "many")).alias("reps"))
    wanted = by_row.join(texts.select("rid", F.col("digest").alias("_digest"), "_id"), "rid")
    # One row of each text is enough: that of the first id, and of rows that share it any.
    found = _with_digest(docs).join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "reps")
    pieces = written(_contexts(found).dropDuplicates(["h", "c", "w0"]).withColumn("mark", F.xxhash64("data")), "op6-pieces")
    alike, distinct = _met_twice(pieces, "op6-alike")
    # Blocks that differ only beyond the bytes they share, as at the ends of a passage, meet window by window if very many.
    crowded = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > MANY).select("key", F.lit(True).alias("crowded"))
    dealt = written(distinct.join(written(crowded, "op6-crowded"), "key", "left"), "op6-distinct")
    single, _ = _met_twice(written(_windows(dealt.filter("crowded").drop("crowded")), "op6-windows"), "op6-single")
    sorted_here = dealt.filter("crowded IS NULL").drop("crowded")
    size = sorted_here.agg(F.sum(F.octet_length("data")).alias("s")).first()["s"] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    partial = sorted_here.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("task").applyInPandas(_sort_task, "h long, c long, first int, last int")
    runs = written(whole.unionByName(alike).unionByName(single).unionByName(partial), "op6-runs")
    released(pieces, dealt)
    found = shared.join(runs, ["h", "c"])
    return rows.drop("anchors", "rid"), texts, found.select("rid", (F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + LENGTH).alias("b"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, texts, spans = repeated_spans(docs)
    once = texts.filter("k = 1").select("rid", F.col("digest").alias("_digest"))
    wanted = written(spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")).join(once, "rid").drop("rid"), "op6-spans")
    cut = _cut(_with_digest(docs).join(wanted, F.col("digest") == F.col("_digest")).select("text", "digest", "spans"))
    copied = texts.filter("k > 1").select("digest", F.lit(True).alias("copied"))
    # Copies of a text that holds a window go whole.
    gone = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return (
        rows.join(written(copied, "op6-copied"), "digest", "left")
        .join(written(cut, "op6-cut"), "digest", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )


__all__ = ["anchors", "dc_ranks", "remove_repeats", "repeated_spans", "repeated_windows"]
