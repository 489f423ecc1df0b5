"""Request-side state: result cache, job status, pacing, sessions and the sliding-window limiter."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.running import SLICE, dealt, row_numbers, running_max


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "key", at: str = "at_s", ttl: str = "ttl_s") -> DataFrame:
    """requests (key, at_s, ttl_s, ...) plus ``hit`` and ``cached_at`` of the newest entry (key, cached_at) that isn't too old.

    A ttl of 0 never hits, nor does a null key. Requests and entries of a key lie in one order by time, entries first: the newest
    entry before a request is a running maximum, so the work grows with their sum and not with their product, and a key that
    holds most of them spreads over many slices.
    """
    r = requests.withColumn("_entry", F.lit(None).cast("long")).withColumn("_at", F.col(at).cast("long"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in requests.schema]
    entries = cache.select(*blank, F.col("cached_at").cast("long").alias("_entry"), F.col("cached_at").cast("long").alias("_at"))
    both = r.withColumn("_asked", F.lit(True)).unionByName(entries.withColumn("_asked", F.lit(False)))
    order = [F.col("_at").asc_nulls_first(), F.col("_asked").asc()]
    seen = running_max(dealt(both, [F.col(key), *order]), [key], order, F.col("_entry"), "_last").filter("_asked")
    fresh = (F.col(ttl) > 0) & F.col(key).isNotNull() & (F.col(at) - F.col("_last") <= F.col(ttl))
    return seen.withColumn("cached_at", F.when(fresh, F.col("_last"))).withColumn("hit", F.col("cached_at").isNotNull()).drop("_entry", "_at", "_asked", "_last", SLICE)


def cache_stats(cache: DataFrame, key: str = "key") -> DataFrame:
    """One row: n_keys and n_writes of the entries of a cache."""
    return cache.agg(F.countDistinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_writes"))


def cache_write(entries: DataFrame, path: str, default_ttl_s: int = 86_400) -> None:
    """Append cache entries as zstd Parquet, dealt by the first byte of the key."""
    rows = entries.withColumn("ttl_s", F.coalesce(F.when(F.col("ttl_s") > 0, F.col("ttl_s")), F.lit(default_ttl_s))).withColumn("part", F.substring(F.sha2("key", 256), 1, 2))
    rows.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(path)


def cache_without(cache: DataFrame, urls: DataFrame) -> DataFrame:
    """The cache without the entries of some URLs."""
    return cache.join(urls.select("url").distinct(), "url", "left_anti")


def evicted(rows: DataFrame, now_s: int, at: str = "created_s", ttl_s: int = 3600, states: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Jobs that are done and older than their time to live."""
    return rows.filter(F.col("status").isin(*states) & (F.lit(now_s) - F.col(at) > ttl_s))


def latest_state(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """The last state of each job by sequence number."""
    return events.groupBy(key).agg(F.max_by(state, seq).alias(state), F.max(seq).alias(seq), F.count(F.lit(1)).alias("n_events"))


def paced(requests: DataFrame, key: str, at_ms: str, order: str, gap_ms: int) -> DataFrame:
    """``start_ms`` and ``wait_ms`` of requests of one domain kept ``gap_ms`` apart.

    start[i] = max(at[i], start[i-1] + gap) unrolls to i * gap + max over j <= i of (at[j] - j * gap): a running number and a running
    maximum, both in two levels, so that a domain with most of the requests is many tasks.
    """
    by = [F.col(at_ms).asc_nulls_first(), F.col(order).asc_nulls_first()]
    d = row_numbers(dealt(requests, [F.col(key), *by]), [key], by, "_i").withColumn("_i", F.col("_i") - 1)
    d = running_max(d, [key], by, F.col(at_ms) - F.col("_i") * gap_ms, "_lead")
    return d.withColumn("start_ms", F.col("_lead") + F.col("_i") * gap_ms).withColumn("wait_ms", F.col("start_ms") - F.col(at_ms)).drop("_i", "_lead", SLICE)


def idle_sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity that a quiet ``gap`` ends: (key, session_start, session_end, n)."""
    g = events.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_at"))
    return g.select(key, F.col("s.start").alias("session_start"), "last_at", "n")


def accept(times, window: float, most: int, kept=None) -> tuple[list[bool], list[float]]:
    """Sliding-window limiter: a request passes while fewer than ``most`` passed in the last ``window``. Only passed ones count.

    ``times`` rise. While the window is full the walk jumps to the first request after the oldest pass has left it, so the steps
    taken are those of the passes, not of the requests.
    """
    t = np.asarray(times, float)
    ok, live, i = np.zeros(len(t), bool), deque(kept or []), 0
    while i < len(t):
        while live and t[i] - live[0] >= window:
            live.popleft()
        if len(live) < most:
            ok[i] = True
            live.append(t[i])
            i += 1
        elif not live:
            break  # nothing ever passes
        else:
            i = max(i + 1, int(np.searchsorted(t, live[0] + window)) - 1)  # a place earlier: sums round, differences decide
            while i < len(t) and t[i] - live[0] < window:
                i += 1
    while live and len(t) and t[-1] - live[0] >= window:
        live.popleft()
    return ok.tolist(), [float(x) for x in live]


def segments(events: DataFrame, key: str, at_s: str, order: str, window_s: float) -> DataFrame:
    """(key, order, at_s) with ``_segment``: the time of the key's last event that a quiet window came before.

    No pass from before a quiet gap of a whole window is still counted behind it, so each segment is a limiter of its own.
    """
    by = [F.col(at_s).asc_nulls_first(), F.col(order).asc_nulls_first()]
    d = dealt(events.select(key, order, at_s), [F.col(key), *by], tag="limiter")
    d = running_max(d, [key], by, F.col(at_s), "_before", before=True)
    starts = F.col("_before").isNull() | (F.col(at_s) - F.col("_before") >= window_s)
    d = running_max(d, [key], by, F.when(starts, F.col(at_s)), "_segment")
    return d.drop("_before", SLICE)


def limited(events: DataFrame, key: str, at_s: str, order: str, window_s: float, most: int) -> DataFrame:
    """(key, order, at_s, allowed): whether one passed decides over later ones, so each segment of a key is walked in order.

    Segments (see :func:`segments`) are dealt over all tasks: a key with most of the events is spread as far as it has quiet
    windows. One that never pauses for a window is a single walk, whose steps are its passes - few, as the window bounds them - over
    times that arrive in Arrow batches; only the passes of the last window are kept. Null keys are one key; events without a time pass, as no
    window holds them, and count for none.
    """
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {at_s} {kinds[at_s]}, allowed boolean"

    def run(batches):
        last, live = None, []
        for pdf in batches:
            keys, times = pdf[key].tolist(), pdf[at_s].to_numpy()
            code, segment = pd.factorize(pdf[key])[0], pdf["_segment"].to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (segment[1:] != segment[:-1])) + 1).tolist(), len(pdf)]
            allowed: list[bool] = []
            for a, b in zip(cuts, cuts[1:]) if len(pdf) else ():
                own = (None if pd.isna(keys[a]) else keys[a], segment[a])
                ok, live = accept(times[a:b], window_s, most, live if last == own else [])
                last = own
                allowed += ok
            yield pd.DataFrame({key: pdf[key], order: pdf[order], at_s: pdf[at_s], "allowed": allowed})

    timed = segments(events.filter(F.col(at_s).isNotNull()), key, at_s, order, window_s)
    rows = timed.repartition(F.col(key), F.col("_segment")).sortWithinPartitions(key, "_segment", at_s, order)
    untimed = events.filter(F.col(at_s).isNull()).select(key, order, at_s, F.lit(True).alias("allowed"))
    return rows.mapInPandas(run, schema).unionByName(untimed)
