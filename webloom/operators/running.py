"""Running figures over ordered keys, in two levels: a key that holds most rows is never one task.

Rows are dealt into slices, ranges of (key, order) of about equal size, so that a hot key spreads over many slices and a
slice's rows are one stretch of the order. A figure runs inside each slice, and what a key's earlier slices add up to is carried in. As slices
are ranges, a key reaches into a further slice at most once per cut: the carried rows number fewer than the slices, a proven bound for the broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.sources.shared import saved

SLICE = "_slice"
#: Slices a table is dealt into; more rows than a task should sort want more of them.
SLICES = 64


def dealt(rows: DataFrame, order: list[Column], slices: int | None = None, tag: str = "slices") -> DataFrame:
    """``rows``, written in ranges of ``order`` and with the number of the range: sampled cuts, rising with the order."""
    n = slices or max(SLICES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return saved(rows.repartitionByRange(n, *order).withColumn(SLICE, F.spark_partition_id()), tag)


def carried(rows: DataFrame, keys: list[str], value: Column, fold: Callable[[Column], Column], out: str) -> DataFrame:
    """``rows`` (dealt) with ``out``: ``fold`` of ``value`` over the key's rows in earlier slices; null where there are none."""
    totals = rows.groupBy(*keys, SLICE).agg(fold(value).alias("_total"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*(F.col(k).alias(f"_carry_{i}") for i, k in enumerate(keys)), F.col(SLICE).alias("_carry_slice"), fold(F.col("_total")).over(earlier).alias(out)).filter(F.col(out).isNotNull())
    same = F.col(SLICE) == F.col("_carry_slice")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_carry_{i}"))
    return rows.join(F.broadcast(carry), same, "left").drop("_carry_slice", *(f"_carry_{i}" for i in range(len(keys))))


def _inside(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def running_max(rows: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, before: bool = False) -> DataFrame:
    """``rows`` (dealt by keys and order) with the largest ``value`` of the key so far; ``before``: without the row itself."""
    d = carried(rows, keys, value, F.max, "_carried")
    here = F.max(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return d.withColumn(out, F.greatest(here, F.col("_carried"))).drop("_carried")  # greatest skips nulls


def row_numbers(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` (dealt by keys and order) with the row's number in its key, from 1."""
    d = carried(rows, keys, F.lit(1).cast("long"), F.sum, "_carried")
    return d.withColumn(out, (F.coalesce("_carried", F.lit(0)) + F.row_number().over(_inside(keys, order))).cast("long")).drop("_carried")
