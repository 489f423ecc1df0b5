"""The cache as a log: sets, deletes, flushes of a URL and of everything, folded to the state at a time, and compaction of the stored log.

Operations (op, key, url, data, ttl_s, at_s, seq) are taken in order of (at_s, seq). A set replaces the key's entry; a delete removes it; a flush removes
every entry of its URL, ``flush_all`` every entry; an entry expires ``ttl_s`` after its set (the default ttl where none is given). The fold is
aggregates only: per key its last set or delete, per URL its last flush, and one figure for ``flush_all``, so a hot key or URL costs each task one row.

Stored, an entry lies in a partition by its key's digest and flushes lie in a partition of their own. Compaction reads the sums of every
partition, but rewrites only those that hold something dead, by dynamic partition overwrite: the new files are written before the old ones go, so a lost
executor, or a failed job, leaves the log as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.shared import saved

SET, DELETE, FLUSH, FLUSH_ALL, MARK = "set", "delete", "flush", "flush_all", "mark"
DEFAULT_TTL_S = 86_400
COLUMNS = "op string, key string, url string, data string, ttl_s long, at_s long, seq long"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
FLUSHES = "flushes"


def _order() -> Column:
    return F.struct("at_s", "seq")


def _ttl() -> Column:
    return F.coalesce(F.when(F.col("ttl_s") > 0, F.col("ttl_s")), F.lit(DEFAULT_TTL_S))


def live(log: DataFrame, now_s: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The sets that are the cache at ``now_s``, one a key: columns of the log, and ``extra`` ones."""
    log = log.filter(F.col("at_s") <= now_s)
    entry = F.struct(*_NAMES, *extra)
    keyed = log.filter(F.col("op").isin(SET, DELETE) & F.col("key").isNotNull())
    last = keyed.groupBy("key").agg(F.max_by(entry, _order()).alias("x")).select("x.*").filter(F.col("op") == SET)
    last = last.filter(F.col("at_s") + _ttl() > now_s)
    flushed = log.filter(F.col("op") == FLUSH).groupBy("url").agg(F.max(_order()).alias("_flushed"))
    everything = log.filter(F.col("op") == FLUSH_ALL).agg(F.max(_order()).alias("_all"))  # one row
    kept = last.join(flushed, "url", "left").crossJoin(F.broadcast(everything))
    later = lambda c: F.col(c).isNull() | (_order() > F.col(c))
    return kept.filter(later("_flushed") & later("_all")).select(*_NAMES, *extra)


def lookup(log: DataFrame, requests: DataFrame, now_s: int) -> DataFrame:
    """requests (key, ...) with ``data`` and ``hit``, as the cache answers at ``now_s``."""
    found = live(log, now_s).select("key", "data", F.lit(True).alias("hit"))
    return requests.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def stats(log: DataFrame, now_s: int) -> DataFrame:
    """One row: keys that are there, and the bytes of their data."""
    return live(log, now_s).agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("n_bytes"))


def _part() -> Column:
    return F.when(F.col("op").isin(FLUSH, FLUSH_ALL), FLUSHES).otherwise(F.substring(F.sha2(F.coalesce("key", F.lit("")), 256), 1, 2))


def append(operations: DataFrame, path: str) -> None:
    """Add operations to the stored log, as zstd Parquet by partition."""
    rows = operations.select(*_NAMES).withColumn("part", _part())
    rows.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored log, with ``part``."""
    return spark.read.schema(f"{COLUMNS}, part string").parquet(path).filter(F.col("op") != MARK)


def compact(spark: SparkSession, path: str, now_s: int) -> list[str]:
    """Drop what is dead at ``now_s`` from the stored log; operations after ``now_s`` stay. Returns the partitions rewritten.

    A partition without dead rows isn't touched. Flushes are folded to the last one of each URL; they stay, as an older set may still be appended. At
    most 257 partition names come to the driver.
    """
    log = read(spark, path)
    alive = saved(live(log, now_s, ("part",)).withColumn("part", F.col("part")), "cache-live")
    flushes = log.filter((F.col("part") == FLUSHES) & (F.col("at_s") <= now_s))
    flushes = flushes.groupBy("op", F.when(F.col("op") == FLUSH, F.col("url")).alias("_url")).agg(F.max_by(F.struct(*_NAMES, "part"), _order()).alias("x")).select("x.*")
    keep = alive.unionByName(flushes).unionByName(log.filter(F.col("at_s") > now_s))
    sizes = log.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(keep.groupBy("part").agg(F.count(F.lit(1)).alias("kept")), "part", "left")
    stale = sorted(r["part"] for r in sizes.filter("n > coalesce(kept, 0)").collect())
    if not stale:
        return []
    marks = spark.createDataFrame([(MARK, None, None, None, None, now_s, 0, p) for p in stale], f"{COLUMNS}, part string")  # an emptied partition is rewritten as well
    fresh = saved(keep.filter(F.col("part").isin(stale)).unionByName(marks).repartition("part", F.pmod(F.xxhash64("key"), F.lit(4))), "cache-compact")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(path)
    return stale
