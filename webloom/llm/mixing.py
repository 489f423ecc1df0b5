"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only.

Targets: sources, in code-point order with null last, weigh 5, 2, 1 repeating and share the whole corpus size. A
target stops at ``max_epochs`` times its source's size; what is over is reshared by weight among the others until no
target is above its cap. The fixed point is a water level L: target = min(cap, weight * L), and it has a closed form
after sorting sources by cap / weight.

Taking: with r = target / source size, every document is taken floor(r) times whole; the rest of the target is
filled with one more repetition of documents in a seeded order, of which the last one is taken in part (its first
words). So each source gives its target to the word, and the same seed gives the same mix.

The order is that of a hash of seed, doc_id and text. Running sums go in two levels, by leading digits of the hash and
inside one such bucket, so that neither a source nor an id that names many texts lands in one task.

Edge cases: null and empty texts have size 0 and are never taken; very long texts count whole; a null source is a source
of its own; a source of size 0 has target 0; ties between sources go by code point, null last; an empty table gives an
empty result; rows repeated with one doc_id and text are separate, interchangeable rows; extra columns are ignored by
:func:`mix` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import ROW_ID, core, with_row_ids, word_count, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that a bucket of the two-level running sum may hold; a bucket is a source's rows with the same leading hex digits.
BUCKET_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``target`` by capped water-filling. One row a source, so the windows are small."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    rising = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    from_here = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    s = s.withColumn("level", level)
    # The level rises while sources below it are capped and would fall if others were: its maximum is the water level.
    s = s.withColumn("water", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def _place(seed: int):
    """The seeded order key: lowercase hex."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken (words the mix takes, repetitions counted)."""
    rows = core(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("place"))
    rows = written(rows, "op9")
    return _taken(rows, weights, max_epochs).select("doc_id", "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """rows, written: doc_id, source, size, place (seeded order key, lowercase hex), and more; adds source_size, target, taken."""
    bucket = F.substring("place", 1, max(3, ceil(log(max(1, rows.count() / BUCKET_ROWS), 16))))
    sums = rows.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    wanted = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    offsets = offsets.alias("o").join(wanted.alias("w"), F.expr("o.source <=> w.source")).select("o.source", "o.bucket", "o.before", "w.source_size", "w.target")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source AND d.bucket = o.bucket"))
    d = d.select(*(f"d.{c}" for c in rows.columns), "o.source_size", "o.target", (F.col("o.before") + F.col("d.inside")).alias("_start"))
    goal = F.floor(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    rest = goal - whole * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return d.withColumn("taken", (whole * F.col("size") + extra).cast("long")).drop("_start")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, a partial repetition cut to its first words.

    Columns are those of ``docs``; ``n_chars``, where there is one, follows the text.
    """
    columns = docs.columns
    keyed = with_row_ids(docs, "op9-docs")
    rows = written(keyed.select(ROW_ID, "doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("place")), "op9-rows")
    taken = _taken(rows, WEIGHTS, MAX_EPOCHS).filter("taken > 0").select(ROW_ID, F.col("size").alias("__webloom_size"), F.col("taken").alias("__webloom_taken"))
    copies = keyed.join(taken, ROW_ID).withColumn("__webloom_k", F.explode(F.expr("sequence(1, CAST(ceil(__webloom_taken / __webloom_size) AS INT))")))
    size = F.col("__webloom_size")
    words = F.least(size, F.col("__webloom_taken") - (F.col("__webloom_k") - 1) * size)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), words.cast("int")), "")
    return copies.withColumn("text", F.when(words < size, F.rtrim(cut)).otherwise(F.col("text"))).select(
        *((F.when(words < size, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in columns)
    )


__all__ = ["mix", "mixed_documents", "targets"]
