"""Design tokens of a page, read elsewhere and stored as JSON: fonts, their sources, spacing and shadows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.base import col

STYLE = "struct<primaryColor:string,fontFamily:string,baseSize:string,colors:array<string>,shadows:map<string,string>>"


def fonts(json: Column | str) -> Column:
    """Font families of a token document: an array of names, or an object keyed by them; null for neither."""
    raw = F.get_json_object(col(json), "$.fonts")
    listed = F.from_json(raw, "array<string>")
    keyed = F.map_keys(F.from_json(raw, "map<string,string>"))
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), listed).when(F.startswith(F.ltrim(raw), F.lit("{")), keyed)


def styleguide(json: Column | str) -> Column:
    """The style guide of a token document; null where its three main fields are empty."""
    s = F.from_json(F.get_json_object(col(json), "$.styleguide"), STYLE)
    filled = [F.coalesce(s[f], F.lit("")) != "" for f in ("primaryColor", "fontFamily", "baseSize")]
    return F.when(filled[0] | filled[1] | filled[2], s)


def font_usage(rows: DataFrame, page: str = "page_id", family: str = "family", weight: str = "n_words") -> DataFrame:
    """(page, family, share): per cent of a page's words set in each family, whole numbers, largest first."""
    g = rows.groupBy(page, family).agg(F.sum(weight).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(page))).cast("long")
    return g.select(page, family, share.alias("share")).orderBy(page, F.desc("share"), family)


def spacing_medians(rows: DataFrame, value: str = "value") -> DataFrame:
    """(bucket, median, n): the upper median of the spacings in each size bucket (8, 16, 32, 64, and 999 for more).

    Exact, by sketch and range: see :mod:`webloom.operators.quantiles`.
    """
    from webloom.operators.quantiles import at_ranks

    bucket = F.lit(999)
    for top in (64, 32, 16, 8):
        bucket = F.when(F.col(value) <= top, top).otherwise(bucket)
    kind = dict(rows.dtypes)[value]
    found = at_ranks(rows.filter(F.col(value).isNotNull()).select(bucket.alias("bucket"), F.col(value).alias("v")), "v", ["bucket"], {"median": F.floor(F.col("n") / 2)})
    return found.select("bucket", F.col("median").cast(kind).alias("median"), "n")


def font_sources(files: DataFrame, faces: DataFrame) -> DataFrame:
    """files (file_url) matched with faces (family, src_url): by URL, else by file name, else by its stem. No match: null."""
    name = lambda c: F.regexp_extract(c, r"([^/?#]+)(?:[?#].*)?$", 1)
    stem = lambda c: F.lower(F.regexp_replace(name(c), r"\.[^.]*$", ""))
    first = lambda key, out: faces.select(key.alias("_k"), "family").groupBy("_k").agg(F.min("family").alias(out))
    d = files
    for n, (key, face_key) in enumerate(((F.col("file_url"), F.col("src_url")), (name("file_url"), name("src_url")), (stem("file_url"), stem("src_url")))):
        d = d.withColumn("_q", key).join(first(face_key, f"_f{n}"), F.col("_q") == F.col("_k"), "left").drop("_q", "_k")
    return d.withColumn("family", F.coalesce("_f0", "_f1", "_f2")).drop("_f0", "_f1", "_f2")


def shadow_buckets(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """rows (page_id, ord, shadow) -> the first shadow of each size bucket: by the largest of its blur radii."""
    lengths = F.transform(F.regexp_extract_all("shadow", F.lit(r"(-?[0-9.]+)px"), F.lit(1)), lambda x: x.cast("double"))
    blur = F.coalesce(F.array_max(F.filter(F.transform(lengths, lambda x, i: F.when(i % 3 == 2, x)), lambda x: x.isNotNull())), F.lit(0.0))
    bucket = F.when(blur <= 4, "sm").when(blur <= 12, "md").when(blur <= 24, "lg").otherwise("xl")
    return rows.withColumn("bucket", bucket).groupBy(page, "bucket").agg(F.min_by("shadow", "ord").alias("shadow"))


def best_icon(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """rows (page_id, ord, href, sizes) -> the square icon of the largest size, the first of equals."""
    w, h = (F.regexp_extract("sizes", r"(?i)([0-9]+)x([0-9]+)", k) for k in (1, 2))
    square = rows.withColumn("_w", F.when((w != "") & (w == h), w.cast("int"))).filter("_w IS NOT NULL")
    return square.groupBy(page).agg(F.max_by("href", F.struct("_w", -F.col("ord"))).alias("href"), F.max("_w").alias("size"))
