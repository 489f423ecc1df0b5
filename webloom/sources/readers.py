"""Readers of stored inputs. Schemas are given, never inferred; files may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.base import first_bytes
from webloom.functions.url import clean_content_type, is_binary_content_type, is_pdf_content_type

PAGE_SCHEMA = "page_id long, url string, html string, status int, content_type string, raw binary"
HIT_SCHEMA = "query string, results array<struct<url:string,title:string,content:string,publishedDate:string,pubdate:string,score:double>>"
#: Bytes of a page that are kept.
MOST_BYTES = 10 << 20


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages as rows of PAGE_SCHEMA; columns that a file lacks are null, status 200."""
    d = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)
    for field in ("status int", "content_type string", "raw binary"):
        name, kind = field.split()
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    return d.withColumn("status", F.coalesce("status", F.lit(200)))


def responses(rows: DataFrame) -> DataFrame:
    """Fetched rows to pages: content type cleaned, text capped at MOST_BYTES, PDFs marked, other binaries refused with a warning."""
    ct = clean_content_type(F.coalesce("content_type", F.lit("")))
    d = rows.withColumn("content_type", ct).withColumn("rendered_with", F.when(is_pdf_content_type("content_type"), "pdf").otherwise("http"))
    binary = is_binary_content_type("content_type")
    return d.withColumn("warning", F.when(binary, F.concat(F.lit("unsupported content type "), "content_type"))).withColumn("html", F.when(binary, "").otherwise(first_bytes(F.col("html"), MOST_BYTES)))


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(origin, text): one file an origin, its name the host."""
    d = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_name"))
    return d.select(F.concat(F.lit("https://"), F.regexp_replace("_file", r"\.txt$", "")).alias("origin"), F.substring("value", 1, 256 * 1024).alias("text"))


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("xml"))


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a metasearch as rows: (query, position_in, url, title, content, published, score)."""
    d = spark.read.schema(HIT_SCHEMA).json(path).select("query", F.posexplode("results").alias("position_in", "r"))
    published = F.coalesce(F.when(F.col("r.publishedDate") != "", F.col("r.publishedDate")), F.when(F.col("r.pubdate") != "", F.col("r.pubdate")))
    return d.select("query", (F.col("position_in") + 1).alias("position_in"), "r.url", "r.title", "r.content", published.alias("published"), "r.score")


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def evaluation_set(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Labelled URLs; ``most`` is the number asked for."""
    d = spark.read.parquet(path)
    return d if most is None else d.orderBy("url").limit(most)


#: A table of colour names is a parameter that goes to every task; a larger one is refused.
MOST_NAMES = 100_000


def color_names(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of colour names from CSV (hex, name), as :func:`webloom.functions.color.nearest_name` takes it; a few thousand rows.

    Raises ValueError for a table of more than MOST_NAMES rows.
    """
    rows = spark.read.csv(path, schema="hex string, name string").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} colour names in {path}")
    return {r["hex"].upper().removeprefix("#"): r["name"] for r in rows if r["hex"] and r["name"]}
