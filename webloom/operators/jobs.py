"""The job registry as a table: start, update, delete and eviction folded from a log of events.

A start begins a job's life, and replaces an earlier one of the same id. An update sets the status of a job that is there; others change nothing. A
delete ends the life. A job that is done (completed or failed) goes as soon as it is done and ``ttl`` old, counted from its start. Events of a job are taken in
order of (at, seq); what is due at an event's time happens before the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.running import SLICE, dealt, row_numbers, running_max

DONE, TTL_S = ("completed", "failed"), 3600
START, UPDATE, DELETE = "start", "update", "delete"
STARTED, UNKNOWN, GONE, DELETED = "in_progress", "unknown", "gone", "deleted"


def due(at: Column, created: Column, ttl_s: int) -> Column:
    """When a job goes that is done since ``at``."""
    return F.greatest(at, created + ttl_s)


def job_log(events: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """events (job, at, seq, op, status) -> the same with ``created`` and ``state``: the job's status after each event, or ``unknown`` (never
    started), ``gone`` (deleted or evicted before), ``deleted``.

    Every step is a running figure in two levels, so a job with most of the events isn't one task. ``at`` is in seconds; seq is unique in a job.
    """
    by = [F.col("at").asc(), F.col("seq").asc()]
    d = dealt(events.select("job", "at", "seq", "op", "status"), [F.col("job"), *by], tag="jobs")
    d = row_numbers(d, ["job"], by, "_n")
    starts = F.col("op") == START
    d = running_max(d, ["job"], by, F.when(starts, F.col("_n")), "_life")
    d = running_max(d, ["job"], by, F.when(starts, F.col("at")), "created")
    d = d.withColumn("_now", F.when(starts, STARTED).when(F.col("op") == DELETE, DELETED).otherwise(F.col("status")))
    d = running_max(d, ["job"], by, F.struct("_n", "_life", "at", "_now"), "_last", before=True)
    last = F.col("_last")
    ended = (last["_life"] == F.col("_life")) & ((last["_now"] == DELETED) | (last["_now"].isin(*DONE) & (due(last["at"], F.col("created"), ttl_s) <= F.col("at"))))
    d = d.withColumn("_ended", F.coalesce(ended, F.lit(False)).cast("int"))
    d = running_max(d, ["job", "_life"], by, F.col("_ended"), "_over")
    state = F.when(F.col("_life").isNull(), UNKNOWN).when(F.col("_over") > 0, GONE).otherwise(F.col("_now"))
    return d.withColumn("state", state).drop(SLICE, "_n", "_life", "_now", "_last", "_ended", "_over")


def registry(events: DataFrame, now_s: int, ttl_s: int = TTL_S) -> DataFrame:
    """(job, created, status, updated): the jobs that are there at ``now_s``."""
    log = job_log(events.filter(F.col("at") <= now_s), ttl_s)
    last = log.groupBy("job").agg(F.max_by(F.struct("created", "state", "at"), F.struct("at", "seq")).alias("x")).select("job", "x.created", F.col("x.state").alias("status"), F.col("x.at").alias("updated"))
    here = ~F.col("status").isin(UNKNOWN, GONE, DELETED)
    return last.filter(here & ~(F.col("status").isin(*DONE) & (due(F.col("updated"), F.col("created"), ttl_s) <= now_s)))


def health(jobs: DataFrame) -> DataFrame:
    """One row: the number of jobs in the registry, and of those in progress, completed and failed."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), count(STARTED), *(count(s) for s in DONE))
