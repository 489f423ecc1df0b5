"""The job registry as a stream: one small state a job, with event-time timers that evict what is done.

It follows the rules of :mod:`webloom.operators.jobs`, with the events of a job in order of (at, seq) within a micro-batch and in order of arrival
between them. Needs the RocksDB state store, which :func:`prepared` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webloom.operators.jobs import DELETE, DELETED, DONE, GONE, START, STARTED, TTL_S, UNKNOWN

EVICTED = "evicted"


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Registry(StatefulProcessor):
    """State of a job: (created, status, since). An ended job keeps its state for ``forget_s``, so that late updates are told from those of
    jobs never started; None keeps it for good."""

    def __init__(self, ttl_s: int, forget_s: int | None):
        self.ttl_s, self.forget_s = ttl_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "created long, status string, since long")

    def _due(self, job: tuple) -> int | None:
        """When the job goes, if it is done."""
        return max(job[2], job[0] + self.ttl_s) if job[1] in DONE else None

    def _kept(self, job: tuple) -> None:
        """Store the job and wake up when it has to go or to be forgotten."""
        self.job.update(job)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = self._due(job)
        if job[1] in (GONE, DELETED) and self.forget_s is not None:
            wake = job[2] + self.forget_s
        if wake is not None:
            self.handle.registerTimer(wake * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_s", "seq"])
        job = tuple(self.job.get()) if self.job.exists() else None
        out = []
        for at, seq, op, status in events[["at_s", "seq", "op", "status"]].itertuples(index=False, name=None):
            due = self._due(job) if job else None
            if due is not None and due <= at:
                job = (job[0], GONE, due)
            if op == START:
                job = (at, STARTED, at)
                state = STARTED
            elif job is None:
                state = UNKNOWN
            elif job[1] in (GONE, DELETED):
                state = GONE
            else:
                state = DELETED if op == DELETE else status
                job = (job[0], state, at)
            out.append((key[0], at, seq, state))
        if job is not None:
            self._kept(job)
        yield pd.DataFrame(out, columns=["job", "at_s", "seq", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = tuple(self.job.get()) if self.job.exists() else None
        if job is None:
            return
        due = self._due(job)
        if due is None:
            self.job.clear()  # an ended job that nothing asks for any more
            return
        self._kept((job[0], GONE, due))
        yield pd.DataFrame({"job": [key[0]], "at_s": [due], "seq": pd.array([None], dtype="Int64"), "state": [EVICTED]})

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, ttl_s: int = TTL_S, late: str = "1 minute", forget_s: int | None = None) -> DataFrame:
    """events (job, at timestamp, seq, op, status) -> (job, at_s, seq, state) for every event, and a row ``evicted`` (seq null) when a timer ends a job."""
    prepared(events.sparkSession)
    kind = dict(events.dtypes)["job"]
    rows = events.withWatermark("at", late).select("job", "at", F.unix_timestamp("at").alias("at_s"), F.col("seq").cast("long").alias("seq"), "op", "status")
    return rows.groupBy("job").transformWithStateInPandas(Registry(ttl_s, forget_s), f"job {kind}, at_s long, seq long, state string", "append", "eventTime")
