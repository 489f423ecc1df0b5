"""The log that takes every batch once: replays, lost tasks, odd rows."""

import os
import pathlib

import pytest

from webloom.streaming import once

SCHEMA = "event_id long, user_id long, event_type string"


@pytest.fixture
def source(spark, sf, tmp_path):
    path = f"{tmp_path}/in"
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(event_id AS long) AS event_id", "cast(user_id AS long) AS user_id", "event_type").repartition(6).write.parquet(path)
    return path


def run(spark, source, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    once.log_once(stream, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()


def ids(spark, tmp_path):
    return sorted(r["event_id"] for r in once.logged(spark, f"{tmp_path}/log", SCHEMA).collect())


def test_a_replayed_batch_writes_nothing_twice(spark, source, tmp_path):
    want = sorted(r["event_id"] for r in spark.read.parquet(source).collect())
    run(spark, source, tmp_path)
    assert ids(spark, tmp_path) == want
    files = set(os.listdir(tmp_path / "log" / once.ROWS))
    last = max(int(p.name) for p in pathlib.Path(tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    os.remove(tmp_path / "ck" / "commits" / str(last))
    (tmp_path / "ck" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run(spark, source, tmp_path)
    assert ids(spark, tmp_path) == want and set(os.listdir(tmp_path / "log" / once.ROWS)) == files


def test_files_of_lost_tasks_are_no_rows(spark, source, tmp_path):
    run(spark, source, tmp_path)
    want = ids(spark, tmp_path)
    (tmp_path / "log" / once.ROWS / "lost.json").write_text('{"event_id": -1, "user_id": 0, "event_type": "x"}\n')
    assert ids(spark, tmp_path) == want
    assert once.remove_unnamed(spark, f"{tmp_path}/log") == 1 and ids(spark, tmp_path) == want


def test_commits_and_aborts(tmp_path):
    import pyarrow as pa

    w = once.OnceWriter(f"{tmp_path}/log")
    batch = pa.RecordBatch.from_pylist([{"a": None, "t": 'q"\n é'}, {"a": 2, "t": None}])
    assert w.write(iter([])).name is None
    first = w.write(iter([batch]))
    w.commit([first, None, once.Written(None, 0)], 0)
    again, other = w.write(iter([batch])), w.write(iter([batch]))
    w.commit([again], 0)
    w.abort([other, None], 1)
    assert os.listdir(tmp_path / "log" / once.ROWS) == [first.name] and os.listdir(tmp_path / "log" / once.BATCHES) == ["0.json"]


def test_an_empty_log(spark, tmp_path):
    assert once.logged(spark, f"{tmp_path}/none", SCHEMA).count() == 0 and once.remove_unnamed(spark, f"{tmp_path}/none") == 0
    w = once.OnceWriter(f"{tmp_path}/log")
    w.commit([w.write(iter([]))], 0)
    assert once.logged(spark, f"{tmp_path}/log", SCHEMA).count() == 0
