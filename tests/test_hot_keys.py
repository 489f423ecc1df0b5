"""Limiter, pacing, cache lookup and ranking against plain loops, with one key that holds nine rows of ten."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import requests, running, search


def hot_rows(n=4000, seed=1, span=400_000):
    """(key, id, at): key ``hot`` nine times of ten, some null keys, repeated times."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c", None]), i, rng.randrange(span)) for i in range(n)]


def per_key(rows):
    out = {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(k, []).append((i, t))
    return out


def plain_limiter(times, window, most):
    live, out = [], []
    for t in times:
        live = [x for x in live if t - x < window]
        out.append(len(live) < most)
        if out[-1]:
            live.append(t)
    return out


@pytest.mark.parametrize(("window", "most"), [(60.0, 2), (5_000.0, 3), (1e9, 1), (60.0, 0)])
def test_limiter_is_the_plain_walk(spark, window, most):
    rows = hot_rows()
    df = spark.createDataFrame([(k, i, float(t)) for k, i, t in rows], "k string, i long, t double")
    got = {r["i"]: r["allowed"] for r in requests.limited(df, "k", "t", "i", window, most).collect()}
    want = {i: ok for events in per_key(rows).values() for (i, _), ok in zip(events, plain_limiter([float(t) for _, t in events], window, most))}
    assert got == want


def test_walk_in_batches_with_fractions():
    rng = random.Random(4)
    for _ in range(300):
        times = sorted(rng.random() * 20 for _ in range(rng.randint(0, 60)))
        window, most, cut = rng.choice([0.1, 0.7, 3.3]), rng.randint(0, 4), rng.randint(0, 60)
        first, live = requests.accept(times[:cut], window, most)
        assert first + requests.accept(times[cut:], window, most, live)[0] == plain_limiter(times, window, most)


def test_events_without_time_pass(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 6.0), (None, 4, 5.0)], "k string, i long, t double")
    assert {r["i"]: r["allowed"] for r in requests.limited(df, "k", "t", "i", 10, 1).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_a_hot_key_spreads_over_segments(spark):
    """No task gets twice the median, though one key holds nine events of ten."""
    df = spark.createDataFrame([(k, i, float(t)) for k, i, t in hot_rows(20_000, span=2_000_000)], "k string, i long, t double")
    parts = requests.segments(df, "k", "t", "i", 60.0).repartition(8, "k", "_segment").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in parts.collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    slices = running.dealt(df, [F.col("k"), F.col("t"), F.col("i")], 16).groupBy(running.SLICE).count().collect()
    sizes = sorted(r["count"] for r in slices)
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]


def test_pacing_is_the_plain_recurrence(spark):
    rows = hot_rows()
    got = {r["i"]: (r["start_ms"], r["wait_ms"]) for r in requests.paced(spark.createDataFrame(rows, "k string, i long, t long"), "k", "t", "i", 90).collect()}
    for events in per_key(rows).values():
        start = None
        for i, t in events:
            start = t if start is None else max(t, start + 90)
            assert got[i] == (start, start - t)


def test_cache_lookup_is_the_newest_entry_before(spark):
    rows = hot_rows(3000, 2)
    rng = random.Random(3)
    asked = [(k, i, t, rng.choice([0, 50, 5_000])) for k, i, t in rows if i % 3]
    entries = [(k, t) for k, i, t in rows if i % 3 == 0]
    r = spark.createDataFrame(asked, "key string, i long, at_s long, ttl_s long")
    got = {x["i"]: x["cached_at"] for x in requests.cache_lookup(r, spark.createDataFrame(entries, "key string, cached_at long")).collect()}
    by_key = {}
    for k, t in entries:
        by_key.setdefault(k, []).append(t)
    for k, i, t, ttl in asked:
        last = max((x for x in by_key.get(k, []) if x <= t), default=None)
        assert got[i] == (last if k is not None and last is not None and ttl > 0 and t - last <= ttl else None)


def test_ranking_of_equal_scores_is_even(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 10, F.col("id").cast("double")).otherwise(0.0).alias("bm25_score"))
    ranks = search.reranked(df, "id")
    got = {r["id"]: r["position"] for r in ranks.collect()}
    want = sorted(range(20_000), key=lambda i: (-(i if i < 10 else 0), i))
    assert [got[i] for i in want] == list(range(1, 20_001))
    sizes = sorted(r["count"] for r in running.dealt(df, [F.desc("bm25_score"), F.asc("id")], 16).groupBy(running.SLICE).count().collect())
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, i long, t double")
    assert requests.limited(none, "k", "t", "i", 10, 1).collect() == [] == requests.paced(none.withColumn("t", F.col("t").cast("long")), "k", "t", "i", 10).collect()
    assert search.reranked(none.withColumn("bm25_score", F.col("t")), "i").collect() == []
