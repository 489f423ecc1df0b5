"""Sinks: answers, per-row logs and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_summary(summary: DataFrame, failures: DataFrame, path: str) -> None:
    """A run's one-row summary with its failure histogram (at most ten rows) in one file."""
    listed = failures.agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("label"))), asc=False).alias("most_common_failures"))
    summary.crossJoin(listed).coalesce(1).write.mode("overwrite").json(path)


def wire_hits(rows: DataFrame) -> DataFrame:
    """Search results as JSON; a score of 0 is left out."""
    fields = [F.when(F.col(c) != 0, F.col(c)).alias(c) if c == "bm25_score" else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*fields)).alias("json"))
