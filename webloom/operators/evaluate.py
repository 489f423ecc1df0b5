"""Extraction quality: phrase recall, leaks, run totals, percentiles, failure histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.html_text import phrases, searchable
from webloom.operators.quantiles import percentiles
from webloom.sources.shared import saved


def score_rows(rows: DataFrame) -> DataFrame:
    """rows (url, markdown, truth_text, lie_text, ...) plus expected/found/forbidden/leaked counts and the two verdicts."""
    low = lambda c, n: F.transform(phrases(F.coalesce(F.col(c), F.lit("")), n), F.lower)
    d = rows.withColumn("_text", searchable(F.coalesce(F.col("markdown"), F.lit("")))).withColumn("_true", low("truth_text", 20)).withColumn("_lies", low("lie_text", 10))
    found = lambda c: F.size(F.filter(F.col(c), lambda p: F.contains(F.col("_text"), p))).cast("long")
    d = d.withColumns({"n_expected": F.size("_true").cast("long"), "n_found": found("_true"), "n_forbidden": F.size("_lies").cast("long"), "n_leaked": found("_lies")})
    return d.withColumns(
        {
            "has_truth": F.col("n_expected") > 0,
            "enough_found": (F.col("n_expected") > 0) & (F.col("n_found") / F.col("n_expected") >= 0.3),
            "leaked": (F.col("n_forbidden") > 0) & (F.col("n_leaked") / F.col("n_forbidden") >= 0.5),
        }
    ).drop("_text", "_true", "_lies")


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def run_totals(scored: DataFrame) -> DataFrame:
    """One row: counts and rates of a run. scored: ok, has_truth, enough_found, leaked, n_expected, n_found."""
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    ok, truth = F.col("ok"), F.col("ok") & F.col("has_truth")
    t = scored.agg(
        F.count(F.lit(1)).alias("total_urls"),
        count(ok).alias("succeeded"),
        count(~ok).alias("failed"),
        count(truth).alias("with_truth"),
        count(truth & F.col("enough_found")).alias("matched"),
        count(ok & F.col("leaked")).alias("leaked_urls"),
        F.coalesce(F.sum(F.when(truth, F.col("n_expected"))), F.lit(0)).alias("phrases_expected"),
        F.coalesce(F.sum(F.when(truth, F.col("n_found"))), F.lit(0)).alias("phrases_found"),
    )
    c = F.col
    return t.withColumns(
        {
            "success_rate": rate(c("succeeded"), c("total_urls")),
            "match_rate": rate(c("matched"), c("with_truth")),
            "match_rate_overall": rate(c("matched"), c("succeeded")),
            "clean_rate": rate(c("succeeded") - c("leaked_urls"), c("succeeded")),
        }
    )


#: The percentiles of a run.
PERCENTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}


def latency(rows: DataFrame, ms: str = "ms") -> DataFrame:
    """Average and interpolated percentiles; 0 for no rows. Exact: see :mod:`webloom.operators.quantiles`."""
    average = rows.select(F.col(ms).cast("double").alias("v")).agg(F.round(F.avg("v"), 1).alias("avg_ms"))  # one row
    found = percentiles(rows, ms, [], PERCENTILES).select(*(F.round(k, 1).alias(k) for k in PERCENTILES), "n")
    both = average.join(F.broadcast(found), F.lit(True), "left")
    return both.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("avg_ms", *PERCENTILES)), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latency_by(rows: DataFrame, group: list[str], ms: str = "ms") -> DataFrame:
    """Average and percentiles of each group, as of a host or a kind of request; groups without a value have no row."""
    found = percentiles(rows, ms, group, PERCENTILES).withColumnsRenamed({g: f"_p_{g}" for g in group})
    average = rows.groupBy(*group).agg(F.round(F.avg(F.col(ms).cast("double")), 1).alias("avg_ms"))
    same = F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    return average.join(found, same).select(*group, "avg_ms", *(F.round(k, 1).alias(k) for k in PERCENTILES), "n")


def failure_histogram(rows: DataFrame, reason: str = "reason", k: int = 10) -> DataFrame:
    """The k most frequent failure labels (first 40 characters; ``unknown`` for none), ties by label."""
    label = F.substring(F.coalesce(F.col(reason), F.lit("")), 1, 40)
    labelled = rows.select(F.when(label == "", "unknown").otherwise(label).alias("label"))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def evaluate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per url, summary) of rows (url, ok, markdown, truth_text, lie_text, ms, reason)."""
    scored = score_rows(rows)
    return scored, run_totals(scored).crossJoin(latency(scored.filter("ok")))  # one row each


#: Phrases looked for in one pass over the documents.
PHRASE_BLOCK = 500


def phrase_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs): documents that hold the whole text of an item, for each row of ``items``.

    A document that holds a phrase holds each of its inner words as a word: texts and phrases meet by the phrase's rarest inner word, as digests
    and words alone. Then each distinct text that has a candidate is fetched once, and the phrase is looked for in it. Phrases without an inner word are a
    query set, held against all documents in blocks of PHRASE_BLOCK.
    """
    phrases = items.select(F.col("text").alias("phrase")).filter("phrase <> ''").distinct()
    inner = F.expr("slice(words, 2, greatest(size(words) - 2, 0))")
    keyed = saved(phrases.withColumn("words", F.split("phrase", r"\s+")).select("phrase", F.md5(F.col("phrase").cast("binary")).alias("p"), F.array_distinct(inner).alias("words")), "phrases")
    texts = docs.filter(F.col("text").isNotNull()).select("text", F.md5(F.col("text").cast("binary")).alias("d"))
    asked = keyed.select("p", F.explode("words").alias("word"))
    own = texts.select("d", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    met = saved(own.join(asked.select("word").distinct(), "word", "left_semi").distinct(), "phrase-words")
    # A word that no text has is the rarest of all: its phrase has no candidate.
    spread = met.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(spread, "word", "left").groupBy("p").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    candidates = saved(met.join(rarest, "word").select("d", "p"), "phrase-candidates")
    fetched = texts.join(candidates.select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("k"))
    held = candidates.join(keyed.select("p", "phrase"), "p").join(fetched, "d").filter(F.contains("text", "phrase"))
    found = held.groupBy("phrase").agg(F.sum("k").alias("n"))
    short = [r["phrase"] for r in keyed.filter("size(words) = 0").select("phrase").orderBy("phrase").toLocalIterator()]
    for at in range(0, len(short), PHRASE_BLOCK):
        block = F.array(*(F.lit(p) for p in short[at : at + PHRASE_BLOCK]))
        hits = docs.select("text", F.explode(F.filter(block, lambda p: F.contains(F.col("text"), p))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(hits)
    return items.join(found, F.col("text") == F.col("phrase"), "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
