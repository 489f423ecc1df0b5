"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

A text is cut by the vocabulary's pattern; each piece is merged by itself. Within a slice of texts every distinct piece is
encoded once: pieces that are tokens as a whole need no merge, the others go into matrices of one row a piece, bucketed by
length and padded. In each round every row looks up its least rank, merges the leftmost pair of that rank and closes the
gap, so that all rows of a matrix grow shorter together; rows without a pair left are taken out. Ranks of pairs lie in a
hash table with open addresses, looked up for whole matrices at once. Pieces of more than ``LONG`` bytes, whose rounds would cost the
square of their length, are merged by a heap of (rank, place) instead: the same merges in the same order.

The vocabulary (a rank file, of bounded size: it doesn't grow with the data) is read on the driver and broadcast. Texts are
only ever mapped: no shuffle, and a batch is worked on in slices of bounded size, a very long text in blocks of pieces.

Edge cases: a null or empty text gives no ids and decodes to no bytes; very long texts and pieces are encoded whole; repeated rows give one row
each; an empty table gives an empty result; null ids stay; extra columns are left out. Strings of special tokens are ordinary text. ``decode`` takes
null as no ids and refuses ids outside the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core

#: Pieces of more bytes than this are merged by a heap.
LONG = 512
#: Cells of a padded matrix, pieces of a block of one text, and values gathered at once: bounds of a worker's memory.
CELLS, BLOCK = 1 << 19, 1 << 17
NONE = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank of the merged token, as a hash table in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys that want one slot the last stays
            self.values[at[free]] = values[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none; an id of -1 is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        flat = np.where((left < 0) | (right < 0), np.int64(-1), keys).ravel()
        out = np.full(len(flat), NONE, np.int32)
        todo = np.flatnonzero(flat >= 0)
        at = self._slot(flat[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(left.shape)


@dataclass
class Vocabulary:
    """Ranks, pairs and bytes of the tokens; a token's id is its rank."""

    ranks: dict[bytes, int]
    pattern: str
    byte_ids: np.ndarray = field(init=False)
    pairs: PairTable = field(init=False)
    token_bytes: np.ndarray = field(init=False)
    token_at: np.ndarray = field(init=False)
    token_len: np.ndarray = field(init=False)

    def __post_init__(self):
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, the first is {missing[0]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.token_len = np.full(max(self.ranks.values()) + 1, -1, np.int64)
        for token, rank in self.ranks.items():
            self.token_len[rank] = len(token)
        self.token_at = np.cumsum(np.maximum(self.token_len, 0)) - np.maximum(self.token_len, 0)
        self.token_bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each (s, n), one behind the other."""
    out = np.empty(int(counts.sum()), values.dtype)
    at = 0
    for i in range(0, len(starts), BLOCK):
        s, n = starts[i : i + BLOCK], counts[i : i + BLOCK]
        total = int(n.sum())
        out[at : at + total] = values[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total)]
        at += total
    return out


def merge_rows(ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge each row of a matrix padded with -1. Returns (row numbers, ids a row, ids one behind the other), in one order."""
    done, rows = [], np.arange(len(ids))
    ranks = pairs(ids[:, :-1], ids[:, 1:])
    while len(rows):
        width = ids.shape[1]
        best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
        going = ranks[np.arange(len(rows)), best] < NONE if width > 1 else np.zeros(len(rows), bool)
        if not going.all():
            over = ids[~going]
            done.append((rows[~going], (over >= 0).sum(axis=1), over[over >= 0]))
            rows, ids, ranks, best = rows[going], ids[going], ranks[going], best[going]
            if not len(rows):
                break
        n, every = len(rows), np.arange(len(rows))
        ids[every, best] = ranks[every, best]
        stays = np.ones(ids.shape, bool)
        stays[every, best + 1] = False
        ids = ids[stays].reshape(n, width - 1)
        stays = np.ones(ranks.shape, bool)
        stays[every, best] = False
        ranks = ranks[stays].reshape(n, width - 2)
        left, right = best > 0, best < width - 2
        i = every[left], best[left]
        ranks[i[0], i[1] - 1] = pairs(ids[i[0], i[1] - 1], ids[i])
        i = every[right], best[right]
        ranks[i] = pairs(ids[i], ids[i[0], i[1] + 1])
    return tuple(np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))


def merge_long(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """The same merges for one very long piece, by a heap of (rank, place) over linked neighbours."""
    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
    heap = [(r, i) for i, r in enumerate(vocab.pairs(ids[:-1], ids[1:]).tolist()) if r != NONE]
    heapq.heapify(heap)
    n, now = len(ids), ids.tolist()
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    token = {v: k for k, v in vocab.ranks.items()}

    def rank(i: int) -> int | None:
        j = following[i]
        return vocab.ranks.get(token[now[i]] + token[now[j]]) if j < n else None

    while heap:
        r, i = heapq.heappop(heap)
        if now[i] < 0 or rank(i) != r:
            continue  # one of the two has been merged since
        j = following[i]
        now[i], now[j] = r, -1
        following[i] = following[j]
        if following[j] < n:
            before[following[j]] = i
        for k in (before[i], i):
            if k >= 0 and (fresh := rank(k)) is not None:
                heapq.heappush(heap, (fresh, k))
    return np.array([x for x in now if x >= 0], np.int32)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids one behind the other, start of each piece, number of each piece's ids)."""
    whole = np.array([vocab.ranks.get(p, -1) for p in pieces], np.int32)
    parts = [(np.flatnonzero(whole >= 0), np.ones(int((whole >= 0).sum()), np.int64), whole[whole >= 0])]
    lengths = np.array([len(p) for p in pieces], np.int64)
    for i in np.flatnonzero((whole < 0) & (lengths > LONG)).tolist():
        ids = merge_long(pieces[i], vocab)
        parts.append((np.array([i]), np.array([len(ids)]), ids))
    short = np.flatnonzero((whole < 0) & (lengths <= LONG))
    short = short[np.argsort(lengths[short], kind="stable")]
    at = 0
    while at < len(short):
        # A bucket: pieces up to a quarter longer than its shortest, as many as the bound on cells lets in.
        least = int(lengths[short[at]])
        width = least + least // 4
        bucket = short[at : min(at + max(1, CELLS // width), int(np.searchsorted(lengths[short], width, "right")))]
        at += len(bucket)
        raw = np.frombuffer(b"".join(pieces[i] for i in bucket.tolist()), np.uint8)
        ids = np.full((len(bucket), int(lengths[bucket[-1]])), -1, np.int32)
        ids[np.arange(ids.shape[1]) < lengths[bucket][:, None]] = vocab.byte_ids[raw]
        rows, counts, flat = merge_rows(ids, vocab.pairs)
        parts.append((bucket[rows], counts, flat.astype(np.int32)))
    counts = np.zeros(len(pieces), np.int64)
    starts = np.zeros(len(pieces), np.int64)
    base = 0
    for rows, n, flat in parts:
        counts[rows] = n
        starts[rows] = base + np.cumsum(n) - n
        base += len(flat)
    return np.concatenate([flat for _, _, flat in parts]), starts, counts


def _pieces(text: str, pattern) -> Iterable[list[str]]:
    """The matches of the pattern, in blocks."""
    if len(text) < BLOCK:
        return [pattern.findall(text)]
    found = pattern.finditer(text)
    return iter(lambda: [m.group() for m in islice(found, BLOCK)], [])


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one behind the other, number of each text's ids)."""
    pattern = regex.compile(vocab.pattern)
    blocks, n_pieces = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for block in _pieces(text or "", pattern):
            blocks.append(pa.array(block, pa.string()))
            n_pieces[i] += len(block)
    distinct = pa.chunked_array(blocks, pa.string()).combine_chunks().dictionary_encode()
    flat, starts, counts = encode_pieces(distinct.dictionary.cast(pa.binary()).to_pylist(), vocab)
    at = distinct.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(counts[at])])
    return gather(flat, starts[at], counts[at]), np.diff(ends[np.concatenate([[0], np.cumsum(n_pieces)])])


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _shared(df: DataFrame, path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int)."""
    shared = _shared(docs, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        flat, sizes = encode_texts(batch.column("text").to_pylist(), shared.value)
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(flat, pa.int32()))}

    return arrow_map(core(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of the tokens in order."""
    shared = _shared(encoded, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        vocab, lists = shared.value, batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(vocab.token_len) or (vocab.token_len[flat] < 0).any()):
            raise ValueError("an id lies outside the vocabulary")
        lengths = vocab.token_len[flat]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        tokens = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        data = gather(vocab.token_bytes, vocab.token_at[flat], lengths)
        decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[tokens].astype(np.int32)), pa.py_buffer(data)])
        return {"doc_id": batch.column("doc_id"), "ids": lists, "decoded": decoded}

    return arrow_map(core(encoded, "doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")


__all__ = ["Vocabulary", "decode", "encode", "read_vocabulary"]
