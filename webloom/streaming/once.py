"""A streaming sink of JSON lines that writes each micro-batch once, however often it is replayed.

Tasks write files under new names; the driver then names a batch's files in one manifest, whose name is the batch id. A
batch that has its manifest already is a replay: its new files go. Files that no manifest names, of lost tasks and of
batches that never ended, are not rows of the log. The folder may lie in any store that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Folders of the log: the rows, and the manifests of whole batches.
ROWS, BATCHES = "rows", "batches"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """The file of one task and its rows; no file where the task had no rows."""

    name: str | None
    n_rows: int


class OnceWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        name, n, out = f"{uuid.uuid4().hex}.json", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{root}/{ROWS}", recursive=True)
                out = store.open_output_stream(f"{root}/{ROWS}/{name}", compression=None)
            lines = (json.dumps(row, ensure_ascii=False, default=_plain) for row in batch.to_pylist())
            out.write(("\n".join(lines) + "\n").encode())
            n += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        manifest = f"{root}/{BATCHES}/{batchId}.json"
        if _exists(store, manifest):
            return self.abort(messages, batchId)
        store.create_dir(f"{root}/{BATCHES}", recursive=True)
        lines = [json.dumps({"batch": batchId, "file": m.name, "n_rows": m.n_rows}) for m in messages if m and m.name]
        unfinished = f"{root}/_{batchId}-{uuid.uuid4().hex}"
        with store.open_output_stream(unfinished, compression=None) as out:
            out.write("".join(x + "\n" for x in lines).encode())
        store.move(unfinished, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        for m in messages:
            if m and m.name and _exists(store, f"{root}/{ROWS}/{m.name}"):
                store.delete_file(f"{root}/{ROWS}/{m.name}")


def _plain(x) -> str:
    return x.isoformat() if hasattr(x, "isoformat") else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)


class OnceLog(DataSource):
    """``format("webloom_once")`` with the option ``path``; for writing streams."""

    @classmethod
    def name(cls) -> str:
        return "webloom_once"

    def streamWriter(self, schema: StructType, overwrite: bool) -> OnceWriter:  # noqa: N802
        return OnceWriter(self.options["path"])


def log_once(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch of a stream once. A log belongs to one stream and its checkpoint: the batch ids are that stream's."""
    rows.sparkSession.dataSource.register(OnceLog)
    return rows.writeStream.format(OnceLog.name()).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of whole batches, with ``batch``. The manifests meet the rows in a join by file name: no list passes the driver."""
    store, root = _store(path)
    empty = spark.createDataFrame([], f"{schema}, batch long")
    if not _exists(store, f"{root}/{BATCHES}") or not _exists(store, f"{root}/{ROWS}"):
        return empty
    named = spark.read.schema("batch long, file string").json(f"{path}/{BATCHES}").withColumnRenamed("file", "_file")
    rows = spark.read.schema(schema).json(f"{path}/{ROWS}").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(named, "_file").drop("_file")


def remove_unnamed(spark: SparkSession, path: str) -> int:
    """Delete row files that no manifest names, while no stream writes to the log; returns their number."""
    store, root = _store(path)
    if not _exists(store, f"{root}/{ROWS}"):
        return 0
    files = store.get_file_info(fs.FileSelector(f"{root}/{ROWS}"))
    kept = {json.loads(line)["file"] for info in store.get_file_info(fs.FileSelector(f"{root}/{BATCHES}", allow_not_found=True)) for line in store.open_input_stream(info.path).read().decode().splitlines()}
    lost = [f.path for f in files if f.base_name not in kept and not f.base_name.startswith(".")]
    for name in lost:
        store.delete_file(name)
    return len(lost)
