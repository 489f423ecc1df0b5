"""The cache log against a dictionary, compaction, and the job registry against a plain walk and as a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import cache_log, jobs
from webloom.streaming import jobs as job_streams

LOG = cache_log.COLUMNS


def operations(n=1500, seed=3):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"
        op = rng.choices(["set", "delete", "flush", "flush_all"], [80, 14, 5.5, 0.5])[0]
        out.append((op, None if rng.random() < 0.01 else key, f"u{rng.randrange(12)}", f"d{seq}", rng.choice([None, 0, 50, 400, 5000]), rng.randrange(2000), seq))
    return out


def plain_cache(log, now):
    cache = {}
    for op, key, url, data, ttl, at, seq in sorted((r for r in log if r[5] <= now), key=lambda r: (r[5], r[6])):
        if op == "flush_all":
            cache = {}
        elif op == "flush":
            cache = {k: v for k, v in cache.items() if v[0] != url}
        elif key is not None and op == "delete":
            cache.pop(key, None)
        elif key is not None:
            cache[key] = (url, data, at + (ttl or 86_400))
    return {k: v[1] for k, v in cache.items() if v[2] > now}


@pytest.mark.parametrize("now", [0, 700, 1500, 2000, 9000])
def test_state_is_that_of_a_dictionary(spark, now):
    log = operations()
    got = cache_log.live(spark.createDataFrame(log, LOG), now).collect()
    assert {r["key"]: r["data"] for r in got} == plain_cache(log, now) and len({r["key"] for r in got}) == len(got)


def test_lookup_and_stats(spark):
    log = spark.createDataFrame([("set", "a", "u", "xyz", 0, 10, 1), ("set", "b", "u", "q", 5, 10, 2)], LOG)
    asked = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    assert {r["key"]: (r["hit"], r["data"]) for r in cache_log.lookup(log, asked, 20).collect()} == {"a": (True, "xyz"), "b": (False, None), None: (False, None)}
    assert tuple(cache_log.stats(log, 12).first()) == (2, 4) and tuple(cache_log.stats(log.limit(0), 12).first()) == (0, 0)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_compaction_keeps_the_state_and_touches_only_what_it_must(spark, tmp_path):
    path, log = str(tmp_path / "cache"), operations()
    cache_log.append(spark.createDataFrame(log, LOG), path)
    assert cache_log.compact(spark, path, 1500)
    for now in (1500, 1800, 2500):
        assert {r["key"]: r["data"] for r in cache_log.live(cache_log.read(spark, path), now).collect()} == plain_cache(log, now)
    assert cache_log.read(spark, path).filter("at_s <= 1500 AND op = 'set'").count() == len(plain_cache(log, 1500))
    before = files(path)
    assert cache_log.compact(spark, path, 1500) == [] and files(path) == before
    cache_log.append(spark.createDataFrame([("set", "k7", "u1", "new", 0, 1501, 9001), ("set", "k7", "u1", "newer", 0, 1502, 9002)], LOG), path)
    before = files(path)
    quiet = cache_log.compact(spark, path, 1502)
    part = spark.range(1).select(F.substring(F.sha2(F.lit("k7"), 256), 1, 2)).first()[0]
    assert part in quiet
    gone = {os.path.basename(os.path.dirname(f)) for f in before - files(path)}
    assert gone == {f"part={p}" for p in quiet}


def events(n=1200, seed=5):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        job = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        op = rng.choices(["start", "update", "delete"], [20, 70, 10])[0]
        out.append((job, rng.randrange(20_000), seq, op, rng.choice(["in_progress", "completed", "failed", "completed"])))
    return out


def plain_jobs(rows, ttl):
    out, live = {}, {}
    for job, at, seq, op, status in sorted(rows, key=lambda r: (r[1], r[2])):
        j = live.get(job)
        if j and j[1] in ("completed", "failed") and max(j[2], j[0] + ttl) <= at:
            j = (j[0], "gone", at)
        if op == "start":
            j = (at, "in_progress", at)
            state = "in_progress"
        elif j is None:
            state = "unknown"
        elif j[1] in ("gone", "deleted"):
            state = "gone"
        else:
            state = "deleted" if op == "delete" else status
            j = (j[0], state, at)
        live[job] = j
        out[seq] = state
    return out, live


EVENTS = "job long, at long, seq long, op string, status string"


def test_job_log_is_the_plain_walk(spark):
    rows = events()
    want, live = plain_jobs(rows, 600)
    df = spark.createDataFrame(rows, EVENTS)
    assert {r["seq"]: r["state"] for r in jobs.job_log(df, 600).collect()} == want
    now = 20_000
    here = {j: v[1] for j, v in live.items() if v and v[1] not in ("gone", "deleted") and not (v[1] in ("completed", "failed") and max(v[2], v[0] + 600) <= now)}
    got = jobs.registry(df, now, 600)
    assert {r["job"]: r["status"] for r in got.collect()} == here
    assert jobs.health(got).first()["jobs"] == len(here) and jobs.health(got.limit(0)).first()["jobs"] == 0


def test_stream_equals_the_batch(spark, sf, tmp_path):
    """The stored events, in three files by time, through the stream with its timers."""
    from webloom.plans.queries import _job_events

    batch = _job_events(spark, sf)
    ttl = 2 * 86_400
    want = {r["seq"]: r["state"] for r in jobs.job_log(batch, ttl).collect()}
    src, times = tmp_path / "in", sorted(r["at"] for r in batch.select("at").collect())
    cuts = [times[len(times) * i // 3] for i in range(3)] + [times[-1] + 1]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = batch.filter((F.col("at") >= a) & (F.col("at") < b)).withColumn("at", F.timestamp_seconds("at"))
        part.coalesce(1).write.parquet(str(src / f"{i}"))
    for i, day in ((3, 10), (4, 20)):  # a last job, long after: time passes and timers run out
        tick = spark.createDataFrame([(-1, times[-1] + day * 86_400, 10**9 + i, "start", None)], EVENTS).withColumn("at", F.timestamp_seconds("at"))
        tick.coalesce(1).write.parquet(str(src / f"{i}"))
    schema = spark.read.parquet(str(src / "0")).schema
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        q = job_streams.job_stream(read, ttl).writeStream.format("memory").queryName("registry").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = spark.table("registry").collect()
    assert {r["seq"]: r["state"] for r in rows if r["seq"] is not None and r["job"] >= 0} == want
    evicted = [r for r in rows if r["seq"] is None]
    ended = jobs.registry(batch, times[-1], 10**9).join(jobs.registry(batch, times[-1] + 5 * 86_400, ttl), "job", "left_anti")
    assert {r["state"] for r in evicted} == {"evicted"} and {r["job"] for r in evicted} >= {r["job"] for r in jobs.registry(batch, times[-1], ttl).join(ended, "job", "left_semi").collect()} != set()
