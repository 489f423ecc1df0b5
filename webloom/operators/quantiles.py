"""Exact values at ranks, by group: a mergeable sketch narrows each rank to a short range of values, and only that range is ordered.

A KLL sketch a group, of fixed size, is built by partial aggregation. It gives, for each rank asked for, two values that the rank most likely lies
between; one pass counts exactly what lies below and what lies inside by distinct value. Where a rank turns out to lie outside, its range is widened and
the pass repeated, so the result is exact whatever the sketch says, and an outlier moves no range but its own. The insides are summed in order in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.running import SLICE, _inside, carried, dealt
from webloom.sources.shared import saved

#: Size of a sketch (its rank error is about a quarter of one per cent) and the share of the ranks to each side that is ordered at first.
SKETCH, SHARE = 1024, 0.01
#: Quantiles read off a sketch: 0, 1 / GRID, ... 1.
GRID = 256


def at_ranks(rows: DataFrame, value: str, group: list[str], ranks: dict[str, Column]) -> DataFrame:
    """One row a group: the group's columns, ``n`` values, and for each name the value at that rank, counted from 0.

    ``ranks`` are expressions over ``n``, and stay within 0 and n - 1. Nulls and NaN are left out; a null group is a group.
    """
    names = list(ranks)
    values = rows.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    figures = values.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"))
    grid = F.kll_sketch_get_quantile_double("_s", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))
    figures = figures.filter("n > 0").withColumn("_grid", F.when(F.col("n") > 0, grid)).drop("_s")
    sketches = saved(figures.select("*", *(ranks[k].cast("long").alias(f"_rank_{k}") for k in names)), "quantiles")
    # Names of the groups' columns that the rows' own don't meet.
    keys = [f"_g{i}" for i in range(len(group))]
    sketches = sketches.withColumnsRenamed(dict(zip(group, keys)))
    wanted = sketches.select(*keys, "n", "_lo", "_hi", "_grid", F.explode(F.array(*(F.struct(F.lit(k).alias("_name"), F.col(f"_rank_{k}").alias("_rank")) for k in names))).alias("_x"))
    wanted = saved(wanted.select(*keys, "n", "_lo", "_hi", "_grid", "_x.*"), "quantiles")
    share, done = SHARE, None
    while True:
        at = F.col("_rank") / F.col("n")
        edge = lambda place: F.element_at("_grid", place.cast("int") + 1)
        low = F.when(at - share <= 0, F.col("_lo")).otherwise(edge(F.greatest(F.lit(0), F.floor((at - share) * GRID))))
        high = F.when(at + share >= 1, F.col("_hi")).otherwise(edge(F.least(F.lit(GRID), F.ceil((at + share) * GRID))))
        ranges = saved(wanted.select(*keys, "_name", "_rank", low.alias("_from"), high.alias("_to")), "quantile-ranges")
        found = _inside_ranges(values, group, keys, ranges)
        done = found if done is None else done.unionByName(found)
        missed = saved(wanted.join(found.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)), F.col("_name").alias("_fn")), _same(keys, [f"_f{i}" for i in range(len(keys))]) & (F.col("_name") == F.col("_fn")), "left_anti"), "quantiles")
        if not missed.head(1):
            break
        wanted, share = missed, share * 8
    flat = done.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == k, F.col("_at"))).alias(k) for k in names))
    flat = flat.withColumnsRenamed({k: f"_f{i}" for i, k in enumerate(keys)})
    out = sketches.join(flat, _same(keys, [f"_f{i}" for i in range(len(keys))]))
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), "n", *names)


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out &= F.col(x).eqNullSafe(F.col(y))
    return out


def _inside_ranges(values: DataFrame, group: list[str], keys: list[str], ranges: DataFrame) -> DataFrame:
    """(keys, _name, _at): the value at each rank that lies inside its range."""
    # One row a group, with its ranges: at most as many as ranks asked for. Rows are met once, and only what lies inside is kept.
    lists = ranges.groupBy(*keys).agg(F.collect_list(F.struct("_name", "_rank", "_from", "_to")).alias("_ranges"))
    counted = values.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_k"))  # equal values once, before they meet
    met = counted.join(lists, _same(group, keys)).select(*keys, "_v", "_k", F.explode("_ranges").alias("_r")).select(*keys, "_v", "_k", "_r.*").filter("_v <= _to")
    below = met.groupBy(*keys, "_name").agg(F.sum(F.when(F.col("_v") < F.col("_from"), F.col("_k")).otherwise(0)).alias("_below"))
    below = below.withColumnsRenamed({k: f"_b{i}" for i, k in enumerate(keys)} | {"_name": "_bn"})
    inside = met.filter("_v >= _from").select(*keys, "_name", "_rank", "_v", "_k")
    by, own = [F.col("_v")], [*keys, "_name"]
    d = carried(dealt(inside, [*(F.col(k) for k in own), *by], tag="quantile-slices"), own, F.col("_k"), F.sum, "_carried")
    upto = F.coalesce("_carried", F.lit(0)) + F.sum("_k").over(_inside(own, by))
    d = d.withColumn("_upto", upto).join(below, _same(own, [f"_b{i}" for i in range(len(keys))] + ["_bn"]))
    hit = (F.col("_below") + F.col("_upto") - F.col("_k") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_upto"))
    return saved(d.filter(hit).select(*own, F.col("_v").alias("_at")).drop(SLICE), "quantile-found")


def percentiles(rows: DataFrame, value: str, group: list[str], names: dict[str, float]) -> DataFrame:
    """One row a group: its columns, n, and percentiles interpolated between the two values around (n - 1) * q."""
    ranks = {}
    for name, q in names.items():
        x = (F.col("n") - 1) * F.lit(float(q))
        ranks |= {f"_a_{name}": F.floor(x), f"_b_{name}": F.least(F.floor(x) + 1, F.col("n") - 1)}
    found = at_ranks(rows, value, group, ranks)
    x = lambda q: (F.col("n") - 1) * F.lit(float(q))
    between = [(F.col(f"_a_{k}") + (x(q) - F.floor(x(q))) * (F.col(f"_b_{k}") - F.col(f"_a_{k}"))).alias(k) for k, q in names.items()]
    return found.select(*group, "n", *between)
