"""Streams: job status, bursts of requests, a stateful limiter, and per-row logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.requests import accept


def latest_status(events: DataFrame, key: str = "job_id", seq: str = "seq", status: str = "status") -> DataFrame:
    """The last status of each job; for update or complete mode."""
    return events.groupBy(key).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq), F.count(F.lit(1)).alias("n_events"))


def bursts(events: DataFrame, key: str, at: str, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions that a quiet gap ends, once the watermark has passed them."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def limited(events: DataFrame, key: str, at: str, window_s: float, most: int, late: str = "1 minute") -> DataFrame:
    """(key, at, allowed) for every event; ``at`` is a timestamp. The state of a key is the times of its last passes, and
    goes once the watermark has left them behind."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(at)
        times = (pdf[at].astype("int64") / {"s": 1, "ms": 1e3, "us": 1e6, "ns": 1e9}[pdf[at].dt.unit]).tolist()
        ok, kept = accept(times, window_s, most, kept)
        state.update((kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((times[-1] + window_s) * 1000)))
        yield pd.DataFrame({key: k[0], at: pdf[at], "allowed": ok})

    watched = events.select(key, at).withWatermark(at, late)
    return watched.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def log_rows(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch as JSON lines."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def job_table(active: Iterable[StreamingQuery]) -> list[dict]:
    """Registry of running streams: id, name, whether active, rows of the last progress."""
    return [{"id": str(q.id), "name": q.name, "active": q.isActive, "rows": (q.lastProgress or {}).get("numInputRows") if q.lastProgress else None} for q in active]
