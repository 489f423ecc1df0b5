"""Quality rules with risk-controlled thresholds.

Every text gets five badness ratios. A path of rule sets runs from lax to strict: at each of its levels every rule has
a cut-off that a small share of good documents exceeds, as counted on the fitting quarter of the labels. On the other
three quarters, level by level, an exact (Clopper-Pearson) upper bound on the rate at which the whole rule set rejects
good documents has to stay below ``alpha``; a stratum goes on to the next level only while it does. Trying in an order
fixed beforehand and stopping at the first failure needs no correction over levels (fixed-sequence testing); ``delta``
is divided over all strata (Bonferroni). Strata are the length classes and the languages, both as margins: a document
is rejected only at a level that its length class and its language both admit. So with confidence ``1 - delta`` the
rules reject at most ``alpha`` of the good documents of every length class and of every language. Of the levels that a
stratum admits, it takes the one that catches most bad documents for the fewest good ones. Strata with too few labels
admit none, and the rules stay silent there; :func:`power` tells how many good documents each of them had and what it admits.
The base rule (very short or repetitive texts) is a fixed one and lies outside the guarantee.

Trials have to be independent: equal texts count once, and texts that the fitting quarter holds too don't count. Every
labelled document is in one of the two parts, whatever their number.

Edge cases: a null or empty text has no words and fails the base rule; very long texts are measured whole, one at a
time; labels that are null or belong to no document are ignored, and several for one document count as bad if any does;
an empty label table admits nothing; ties between levels go to the lax one; repeated rows are judged row by row; a null
language is a language of its own beside the rare ones; extra columns are ignored by :func:`apply_quality_rules` and kept
by :func:`filter_by_quality`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from math import exp, lgamma, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACES, arrow_map, core, likely, text_digest, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
RULES = ("symbols", "shouting", "repeats", "dup_lines", "toxic")
#: Lower bounds of the length classes (words): a fixed number, whatever the data.
LENGTHS = (0, 150, 450)
#: Languages that are strata of their own: the most frequent ones among the labels; all others together are one more.
MOST_LANGUAGES = 8
#: Cut-offs that a rule may take, from lax to strict.
CUTOFFS = tuple(round(0.9 * 0.88**k, 6) for k in range(56))
#: Levels of the path: the share of good documents that may exceed each rule's cut-off.
SHARES = (0.0, 0.001, 0.002, 0.004, 0.007, 0.012, 0.02)
#: Bad documents that one falsely rejected good document outweighs when a cut-off is chosen.
COST = 5.0
#: Bytes of a word's beginning that is a term of the lexicon as well.
STEM = 6
#: Bytes that are no part of a word become spaces; bytes of letters beyond ASCII are kept.
_WORD_BYTES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Common signs beyond ASCII that end a word.
_SIGNS = "\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2022\u2026"
_UPPER = bytes(range(65, 91))
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]")

MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "symbols double, shouting double, repeats double, dup_lines double, toxic double"
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a ``window``-word run that occurs at least twice in ``words``; exact, by doubling of ranks."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    length = 1
    while length < window:  # window is a power of two
        pair = rank[: len(rank) - length] * (len(words) + 1) + rank[length:]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1).astype(np.int64)
        length *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(again):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, as UTF-8."""
    low = (text or "").lower()
    if not low.isascii():
        for c in _SIGNS:
            if c in low:
                low = low.replace(c, " ")
    return low.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def count_in(words: list[bytes], known: frozenset[bytes]) -> int:
    return sum(map(known.__contains__, words)) if not known.isdisjoint(words) else 0


def stems(words: set[bytes]) -> set[bytes]:
    """The beginnings of the longer words, marked by a star."""
    return {w[:STEM] + b"*" for w in words if len(w) > STEM}


def terms_in(words: list[bytes], lexicon: frozenset[bytes]) -> int:
    """Words that are, or begin with, a term of the lexicon."""
    own = set(words)
    if lexicon.isdisjoint(own) and lexicon.isdisjoint(stems(own)):
        return 0
    bad = {w for w in own if w in lexicon or len(w) > STEM and w[:STEM] + b"*" in lexicon}
    return sum(map(bad.__contains__, words))


def measure(text: str | None, lexicon: frozenset[bytes] = frozenset(), letters: list[bytes] | None = None) -> tuple:
    """The base counts and the badness ratios of one text; null counts as no words. letters: its letter_words(), where known."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeats = repeat_words(words)
    upper = len(raw) - len(raw.translate(None, _UPPER)) + (0 if text.isascii() else sum(map(str.isupper, _BEYOND_ASCII.findall(text))))
    shout = max(upper / max(1, chars), min(1.0, text.count("!") / max(1, n)) / 2)
    bad = terms_in(letter_words(text) if letters is None else letters, lexicon) if lexicon else 0
    return n, chars, symbols, dups, repeats, symbols / max(1, chars), shout, repeats / max(1, n), dups / max(1, lines), bad / max(1, n)


def measures(docs: DataFrame, lexicon: frozenset[bytes] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and badness ratios per document row; the columns ``keep`` go along."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [x.split()[0] for x in MEASURES.split(", ")][1:]

    def run(batch: pa.RecordBatch) -> dict:
        known = words.value
        rows = [measure(t, known) for t in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in ("doc_id", *keep)} | dict(zip(names, map(list, zip(*rows)), strict=True))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return arrow_map(core(docs, "doc_id", *keep, "text"), run, ", ".join([MEASURES, *(f"{c} {kinds[c]}" for c in keep)]))


def clean_labels(labels: DataFrame) -> DataFrame:
    """One label per document: bad if any label row calls it toxic or of low quality; rows with nulls are ignored."""
    rows = core(labels, "doc_id", "quality", "toxic").dropna()
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def fold():
    """Quarter of a labelled document, by its id: 0 is fitted on, the others are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def lexicon_counts(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], sample_rows: int | None = None, max_terms: int = 50_000) -> DataFrame:
    """(term, fold, clean, toxic): labelled documents with a term, by quarter; the empty term counts the documents.

    All labelled documents count (only where a caller gives ``sample_rows``, that many labels, the smallest hashes); equal texts
    count once, as the least of their ids. Terms are those of at least one in a hundred toxic documents, and of four:
    ``max_terms`` at most, the most frequent first.
    """
    wanted = fold().isin(*folds)
    sample = labels.filter(wanted)
    if sample_rows is not None:
        sample = reduce(DataFrame.unionByName, [labels.filter(fold() == f).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // len(folds)) for f in folds])
    sample = sample.select("doc_id", (F.col("toxic") > 0).alias("toxic"), fold().cast("int").alias("fold"))
    texts = core(docs, "doc_id", "text").filter(wanted)
    # One row a text, by its digest: texts themselves aren't gathered or written. Rows repeated as a whole share one count.
    same = texts.select("doc_id", text_digest().alias("digest")).join(sample, "doc_id").groupBy("digest", "doc_id", "toxic", "fold").agg(F.count(F.lit(1)).alias("copies"))
    owners = same.groupBy("digest").agg(F.min(F.struct("doc_id", "toxic", "fold", "copies")).alias("x")).select("digest", "x.*")
    owners = written(owners, "lexicon-owners")

    def toxic_terms(batch: pa.RecordBatch) -> dict:
        counts: dict[tuple[bytes, int, int], int] = {}
        for text, f, copies in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "copies")), strict=True):
            own = set(letter_words(text))
            for w in own | stems(own) | {b""}:  # the empty term counts the documents
                counts[w, f, copies] = counts.get((w, f, copies), 0) + 1
        return {"term": [w.hex() for w, _, _ in counts], "fold": [f for _, f, _ in counts], "copies": [c for _, _, c in counts], "n": list(counts.values())}

    def totals(found: DataFrame, tag: str) -> DataFrame:
        rows = found.groupBy("term", "fold", "copies").agg(F.sum("n").alias("n"))
        return written(rows.groupBy("term", "fold").agg(F.sum(F.expr("n div copies")).alias("n")), tag)

    side = owners.filter("toxic")
    rows = likely(texts, side, "doc_id").withColumn("digest", text_digest()).join(side, ["doc_id", "digest"]).select("text", "fold", "copies")
    toxic = totals(arrow_map(rows, toxic_terms, "term string, fold int, copies long, n long"), "lexicon-toxic")
    n_toxic = toxic.filter("term = ''").agg(F.sum("n")).first()[0] or 0
    often = toxic.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(4, n_toxic // 100)).orderBy(F.desc("n"), "term").limit(max_terms)
    spark = docs.sparkSession
    numbers = {r["term"]: k for k, r in enumerate(often.collect())}
    numbered = spark.createDataFrame([(k, term) for term, k in numbers.items()], "k int, term string")
    known = spark.sparkContext.broadcast({bytes.fromhex(term): k for term, k in numbers.items()})

    def known_terms(batch: pa.RecordBatch) -> dict:
        number = known.value
        terms = []
        for text in batch.column("text").to_pylist():
            own = set(letter_words(text))
            terms.append([number[w] for w in own | stems(own) | {b""} if w in number])
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "terms": terms}

    # The numbers of a text's terms travel to the labels, not the text.
    side = owners.filter("NOT toxic")
    rows = arrow_map(likely(texts, side, "doc_id").withColumn("digest", text_digest()), known_terms, "doc_id long, digest string, terms array<int>")
    found = rows.join(side, ["doc_id", "digest"]).select(F.explode("terms").alias("k"), "fold", "copies").groupBy("k", "fold", "copies").agg(F.count(F.lit(1)).alias("n"))
    clean = totals(found.join(F.broadcast(numbered), "k"), "lexicon-clean")
    both = toxic.select("term", "fold", F.lit(0).alias("clean"), F.col("n").alias("toxic")).unionByName(clean.select("term", "fold", F.col("n").alias("clean"), F.lit(0).alias("toxic")))
    return both.join(F.broadcast(numbered.select("term")), "term", "left_semi")


def telling_terms(counts: DataFrame, folds: tuple[int, ...], max_terms: int = 5_000) -> frozenset[bytes]:
    """Terms that toxic documents of these quarters use far more than harmless ones: at most ``max_terms``, the most telling first."""
    words = counts.filter(F.col("fold").isin(*folds)).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = words.filter("term = ''").first()
    n_toxic, n_clean = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    if not n_toxic or not n_clean:
        return frozenset()
    rate = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = words.filter((F.col("term") != "") & (F.col("toxic") >= max(4, n_toxic // 100))).withColumn("rate", rate).filter("rate >= 40")
    return frozenset(bytes.fromhex(r.term) for r in best.orderBy(F.desc("rate"), F.desc("toxic"), "term").limit(max_terms).collect())


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> frozenset[bytes]:
    """Words, and beginnings of words, of toxic language, fitted on the fitting quarter of the labels."""
    return telling_terms(lexicon_counts(docs, labels, (0,)), (0,))


def binom_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly, in logarithms."""
    if k >= n:
        return 1.0
    a, b = log(p), log1p(-p)
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(k + 1)))


def rejects_few(false: int, n: int, limit: float, delta: float) -> bool:
    """Whether the exact upper bound (confidence 1 - delta) on a rate seen as ``false`` of ``n`` is at most ``limit``."""
    return n > 0 and false <= limit * n and binom_cdf(false, n, limit) <= delta


class Rules(NamedTuple):
    """What was learned: the path (per rule its cut-offs by level, from lax to strict), the languages that are strata of
    their own, and the number of levels that each stratum admits and takes."""

    lexicon: frozenset[bytes] = frozenset()
    path: dict[str, tuple[float, ...]] = {}
    languages: tuple[str, ...] = ()
    levels: dict[str, int] = {}


def length_class(n_words: int) -> str:
    return f"length {max(b for b in LENGTHS if n_words >= b)}"


def strata(languages: tuple[str, ...]) -> list[str]:
    return [f"length {b}" for b in LENGTHS] + [f"language {x}" for x in (*languages, "other")]


def make_path(counts: dict[tuple[str, int, bool], int]) -> dict[str, tuple[float, ...]]:
    """Cut-offs of every rule by level. counts: (rule, number of CUTOFFS below the value, good) -> documents.

    At a level a rule takes the strictest cut-off that no more than the level's share of good documents exceeds, but
    none stricter than the strictest of those that catch most bad documents for the fewest good ones; a rule that
    catches none has none (2.0).
    """
    out = {}
    for rule in RULES:
        at = lambda good: np.array([counts.get((rule, j, good), 0) for j in range(len(CUTOFFS) + 1)])  # noqa: E731, B023
        good, bad = at(True), at(False)
        above = lambda c: np.cumsum(c[::-1])[: len(CUTOFFS)]  # noqa: E731  documents above the k-th cut-off
        false, caught = above(good), above(bad)
        gain = caught - COST * false
        best = int(np.flatnonzero(gain == gain.max())[-1]) if gain.max() > 0 else -1
        cuts = []
        for share in SHARES:
            fit = np.flatnonzero(false[: best + 1] <= share * max(1, good.sum()))
            cuts.append(CUTOFFS[fit[-1]] if len(fit) else 2.0)
        out[rule] = tuple(cuts)
    return out


def choose_levels(counts: dict[tuple[str, int, bool], int], names: list[str], alpha: float, delta: float) -> dict[str, tuple[int, int, int]]:
    """Per stratum (levels taken, levels admitted, good documents). counts: (stratum, first level that rejects, good) -> documents."""
    out = {}
    for s in names:
        at = lambda good: [counts.get((s, k, good), 0) for k in range(len(SHARES) + 1)]  # noqa: E731, B023
        good, bad = at(True), at(False)
        taken = admitted = 0
        best = 0.0
        for k in range(len(SHARES)):
            false, caught = sum(good[: k + 1]), sum(bad[: k + 1])
            if not rejects_few(false, sum(good), alpha, delta / len(names)):
                break
            admitted = k + 1
            if caught - COST * false > best:
                best, taken = caught - COST * false, k + 1
        out[s] = (taken, admitted, sum(good))
    return out


def _first_level(rule: str, cuts: tuple[float, ...]):
    """The first level whose cut-off the rule's ratio exceeds; the number of levels if none."""
    return sum((F.col(rule) <= c).cast("int") for c in cuts)


def _stratum_columns(languages: tuple[str, ...]) -> tuple:
    length = F.concat(F.lit("length "), F.greatest(*(F.when(F.col("n_words") >= b, b).otherwise(0) for b in LENGTHS)).cast("string"))
    known = F.col("lang").isin(*languages) if languages else F.lit(False)
    return length, F.concat(F.lit("language "), F.when(known, F.col("lang")).otherwise("other"))


def learn(docs: DataFrame, labels: DataFrame, alpha: float, delta: float) -> tuple[Rules, dict[str, tuple[int, int, int]]]:
    """Rules from all labelled documents, and per stratum (levels taken, admitted, good documents)."""
    return _learned(docs, labels, alpha, delta)[:2]


def _learned(docs: DataFrame, labels: DataFrame, alpha: float, delta: float) -> tuple[Rules, dict[str, tuple[int, int, int]], DataFrame]:
    """:func:`learn`, and the measures of every row of ``docs`` besides.

    Texts are measured where they lie, and only their measures meet the labels. Only counts of a fixed number reach the
    driver, beside the lexicon.
    """
    known = clean_labels(labels)
    lexicon = toxic_lexicon(docs, known)
    rows = core(docs, "doc_id", "lang", "text").withColumn("digest", text_digest())
    whole = written(measures(rows, lexicon, ("lang", "digest")), "op1-measures")
    sample = known.select("doc_id", (fold() == 0).alias("fit"), ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"))
    each = whole.join(sample, "doc_id")
    # One row a text; a text of the fitting quarter is none of the holdout.
    own = [F.first(c).alias(c) for c in ("n_words", "n_repeat_words", *RULES)]
    measured = each.groupBy("digest").agg(F.min("lang").alias("lang"), F.max("fit").alias("fit"), F.min("good").alias("good"), *own)
    measured = written(measured, "op1-sample").filter(~base_failed())
    top = measured.filter("fit AND good AND lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    languages = tuple(r["lang"] for r in top.collect())
    rising = list(reversed(CUTOFFS))
    below = lambda r: sum(F.when(F.col(r) > c, 1).otherwise(0) for c in rising)
    by_rule = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), below(r).alias("bucket")) for r in RULES))).alias("x")
    found = measured.filter("fit").select("good", by_rule).groupBy("x.rule", "x.bucket", "good").count().collect()
    path = make_path({(r["rule"], r["bucket"], r["good"]): r["count"] for r in found})
    level = F.least(*(_first_level(r, path[r]) for r in RULES)).alias("level")
    by_stratum = F.explode(F.array(*_stratum_columns(languages))).alias("stratum")
    found = measured.filter("NOT fit").select("good", level, by_stratum).groupBy("stratum", "level", "good").count().collect()
    chosen = choose_levels({(r["stratum"], r["level"], r["good"]): r["count"] for r in found}, strata(languages), alpha, delta)
    return Rules(lexicon, path, languages, {s: taken for s, (taken, _, _) in chosen.items()}), chosen, whole


def power(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[str, tuple[int, int, int]]:
    """Per stratum (levels taken, levels admitted, good documents it was judged by)."""
    return learn(docs, labels, alpha, delta)[1]


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per document row: base counts, ``base_failed``, badness ratios, the rule that rejected it, and ``kept``."""
    rules, _, whole = _learned(docs, labels, alpha, delta)
    measured = whole.drop("digest").withColumn("base_failed", base_failed())
    admitted = F.create_map(*(x for s, n in rules.levels.items() for x in (F.lit(s), F.lit(n))))
    length, language = _stratum_columns(rules.languages)
    measured = measured.withColumn("levels", F.least(admitted[length], admitted[language]))
    rejected = F.coalesce(*(F.when(_first_level(r, rules.path[r]) < F.col("levels"), F.lit(r)) for r in RULES))
    return measured.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("lang", "levels")


def passes(text: str | None, lang: str | None, rules: Rules) -> bool:
    """The verdict on one text, as in :func:`apply_quality_rules`."""
    n, _, _, _, repeats, *ratios = measure(text, rules.lexicon)
    if n < MIN_WORDS or 100 * repeats > 30 * n:
        return False
    levels = min(rules.levels[length_class(n)], rules.levels[f"language {lang if lang in rules.languages else 'other'}"])
    return not any(x > c for rule, x in zip(RULES, ratios, strict=True) for c in rules.path[rule][:levels])


def filter_by_quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each row judged by its own text, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, alpha, delta)[0])

    def run(batches):
        rules = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True)
                yield part.filter(pa.array([passes(t, lang, rules) for t, lang in own], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["apply_quality_rules", "filter_by_quality", "learn", "measure", "power"]
