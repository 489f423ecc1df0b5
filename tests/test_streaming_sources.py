"""Streams on small files, readers, sinks and settings."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.sources import config, readers, sinks
from webloom.streaming import status


def stream(spark, tmp_path, rows, schema, parts=1):
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert status.job_table([q])[0]["name"] == name
    assert q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_latest_status(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", 1, "queued"), ("a", 3, "done"), ("a", 2, "running"), ("b", 1, "queued")], "job_id string, seq long, status string")
    assert {r["job_id"]: r["status"] for r in run(status.latest_status(s), "latest", "complete")} == {"a": "done", "b": "queued"}


def test_limiter_stream(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", float(t)) for t in (0, 1, 2, 3, 10.5, 11)], "k string, t double").withColumn("t", F.timestamp_seconds(F.col("t") + 1000))
    out = run(status.limited(s, "k", "t", 10, 2), "lim", "append")
    assert [r["allowed"] for r in sorted(out, key=lambda r: r["t"])] == [True, True, False, False, True, True]


def test_bursts_wait_for_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 03:00:00")]
    s = stream(spark, tmp_path, rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = {(r["k"], str(r["started"])[11:]): r["n"] for r in run(status.bursts(s, "k", "at"), "bursts", "append")}
    assert out.get(("a", "00:00:00"), 2) == 2 and ("b", "03:00:00") not in out


def test_log_rows(spark, tmp_path):
    s = stream(spark, tmp_path, [("u1", 1), ("u2", 2)], "url string, n long")
    q = status.log_rows(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["url"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["u1", "u2"]


def test_readers(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.com.txt").write_text("User-agent: *\nDisallow: /x")
    assert readers.robots_files(spark, str(tmp_path / "r")).first()["origin"] == "https://a.com"
    (tmp_path / "h.json").write_text(json.dumps({"query": "q", "results": [{"url": "u", "title": "t", "pubdate": "d"}, {"url": "v", "publishedDate": ""}]}))
    rows = readers.hits(spark, str(tmp_path / "h.json")).collect()
    assert [(r["position_in"], r["url"], r["published"]) for r in rows] == [(1, "u", "d"), (2, "v", None)]
    d = spark.createDataFrame([("Image/PNG; q", "bin"), ("text/html", "<p>"), ("application/pdf", "")], "content_type string, html string")
    assert [(r["rendered_with"], r["warning"] is None) for r in readers.responses(d).collect()] == [("http", False), ("http", True), ("pdf", True)]
    (spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).write.parquet(str(tmp_path / "p"))
    assert readers.pages(spark, str(tmp_path / "p")).first()["status"] == 200


def test_sinks(spark, tmp_path):
    sinks.write_summary(spark.createDataFrame([(3,)], "n int"), spark.createDataFrame([("x", 2), ("y", 5)], "label string, n long"), str(tmp_path / "s"))
    assert [f["label"] for f in spark.read.json(str(tmp_path / "s")).first()["most_common_failures"]] == ["y", "x"]
    assert json.loads(sinks.wire_hits(spark.createDataFrame([("u", 0.0)], "url string, bm25_score double")).first()["json"]) == {"url": "u"}


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[crawl]\nmax_depth = 4\n[scrape]\nrespect_robots = true\n")
    s = config.load(str(tmp_path / "c.toml"), {"WEBLOOM_CRAWL_MAX_PAGES": "7"})
    assert (s.crawl.max_depth, s.crawl.max_pages, s.scrape.respect_robots, s.search.limit) == (4, 7, True, 10)
    (tmp_path / "d.toml").write_text("[crawl]\nnope = 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.toml"), {})
