"""Relevance: field-weighted BM25 over title and snippet, ranking and search over stored hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.html_text import tokens
from webloom.operators.running import SLICE, dealt, row_numbers


def query_terms(df: DataFrame, query: str) -> list[str]:
    """The query's tokens, by the same rule as the documents'."""
    row = df.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()
    return list(row["t"])


def term_frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25f(
    docs: DataFrame,
    query: str,
    title: str = "title",
    snippet: str = "snippet",
    title_weight: float = fixed.TITLE_WEIGHT,
    snippet_weight: float = fixed.SNIPPET_WEIGHT,
    by_documents: bool = False,
) -> DataFrame:
    """``docs`` with ``bm25_score``. A repeated query term counts as often as it occurs.

    By default the document frequency of a term is the number of fields (0 to 2) in which any document has it;
    ``by_documents`` counts documents instead, as the formula is usually meant. One aggregate of fixed width gives
    all corpus figures, so the work is one pass for it and one for the scores, whatever the number of documents.
    """
    title_weight, snippet_weight = (w if w > 0 else 1.0 for w in (title_weight, snippet_weight))
    terms = query_terms(docs, query)
    unique = sorted(set(terms))
    split = docs.withColumns({"_t": tokens(F.coalesce(F.col(title), F.lit(""))), "_s": tokens(F.coalesce(F.col(snippet), F.lit("")))})  # once a field
    figures = [F.size(f"_{f}").alias(f"_{f}_dl") for f in "ts"]
    figures += [term_frequency(F.col(f"_{f}"), term).alias(f"_{f}_{k}") for k, term in enumerate(unique) for f in "ts"]
    counted = split.select("*", *figures)
    stats = [F.count(F.lit(1)).alias("_N"), F.avg("_t_dl").alias("_t_avg"), F.avg("_s_dl").alias("_s_avg")]
    for k in range(len(unique)):
        if by_documents:
            stats.append(F.sum(((F.col(f"_t_{k}") > 0) | (F.col(f"_s_{k}") > 0)).cast("long")).alias(f"_df_{k}"))
        else:
            stats.append((F.max((F.col(f"_t_{k}") > 0).cast("long")) + F.max((F.col(f"_s_{k}") > 0).cast("long"))).alias(f"_df_{k}"))
    scored = counted.crossJoin(F.broadcast(counted.agg(*stats)))  # the aggregate is one row
    total = F.lit(0.0)
    for term in terms:
        k = unique.index(term)
        df, n = F.col(f"_df_{k}"), F.col("_N")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
        field = lambda f, w: F.when(
            (F.col(f"_{f}_{k}") > 0) & (F.col(f"_{f}_avg") > 0),  # noqa: B023
            w * (F.col(f"_{f}_{k}") * (fixed.BM25_K1 + 1) / (F.col(f"_{f}_{k}") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * (F.col(f"_{f}_dl") / F.col(f"_{f}_avg"))))),  # noqa: B023
        ).otherwise(0.0)
        total = total + F.when(df > 0, idf * (field("t", title_weight) + field("s", snippet_weight))).otherwise(0.0)
    return scored.select(*docs.columns, total.alias("bm25_score"))


def reranked(scored: DataFrame, tie: str, score: str = "bm25_score", k: int | None = None) -> DataFrame:
    """By score, best first, with ``position`` from 1; ties by ``tie``. With ``k`` only the best k: a top-k, not a full sort.

    Without ``k`` rows are dealt into ranges of (score, tie), numbered inside them and shifted by the rows of better ranges, so
    that no task sorts them all, however many scores are equal.
    """
    if k is None:
        by = [F.desc(score), F.asc(tie)]
        return row_numbers(dealt(scored, by, tag="ranking"), [], by, "position").drop(SLICE)
    ordered = scored.orderBy(F.desc(score), F.asc(tie)).limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(tie))
    return ordered.withColumn("position", F.row_number().over(w).cast("long"))


def search(hits: DataFrame, query: str, use_bm25: bool = True, k: int = 10, renderings: DataFrame | None = None, title_weight: float = fixed.TITLE_WEIGHT, snippet_weight: float = fixed.SNIPPET_WEIGHT) -> DataFrame:
    """Stored hits (url, title, content, score, position) -> ranked results; ``renderings`` (url, markdown) joins what was scraped.

    ``k`` is the number of results asked for. Hits without a rendering stay.
    """
    rows = hits.withColumn("snippet", F.coalesce(F.col("content"), F.lit("")))
    if use_bm25:
        rows = reranked(bm25f(rows, query, "title", "snippet", title_weight, snippet_weight), "position_in" if "position_in" in rows.columns else "url", k=k)
    else:
        rows = rows.withColumn("bm25_score", F.lit(0.0)).orderBy("position_in" if "position_in" in rows.columns else "url").limit(k)
        rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position_in" if "position_in" in rows.columns else "url")).cast("long"))
    rows = rows.withColumn("bm25_score", F.when(F.col("bm25_score") != 0, F.col("bm25_score")))  # left out of the answer where 0
    if renderings is not None:
        rows = rows.join(renderings.select("url", "markdown"), "url", "left")
    return rows


def published(row_date: str = "publishedDate", fallback: str = "pubdate") -> Column:
    return F.coalesce(F.when(F.col(row_date) != "", F.col(row_date)), F.when(F.col(fallback) != "", F.col(fallback)))
