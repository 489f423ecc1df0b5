"""Nearest names by lattice against every name tried, over a long table of names made from a rule."""

from pyspark.sql import functions as F

from webloom.functions import color
from webloom.sources import readers

#: As many names as a long public table has; two share a colour, for ties.
NAMES = {f"{k * 2654435761 % 2**24:06X}": f"n{k % 1400:04d}" for k in range(1, 1566)}


def colors_of(spark, sf):
    greys = spark.range(256).select(F.concat(F.lit("#"), F.repeat(F.lpad(F.hex("id"), 2, "0"), 3)).alias("hex"))
    odd = spark.createDataFrame([("#fff",), ("#ABCD",), ("#12345678",), ("#ff0000",), ("#ff0000",)], "hex string")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("#"), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 6)).alias("hex"))
    return lines.unionByName(greys).unionByName(odd)


def test_same_as_every_name(spark, sf):
    d = colors_of(spark, sf)
    points = color.named_points(NAMES)
    got = color.nearest_name(d, "hex", NAMES).collect()
    assert len(got) == d.count()
    hexes = {r["hex"]: (r["color_name"], r["color_distance"]) for r in got}
    for h in [*(f"#{k:02X}{k:02X}{k:02X}" for k in range(0, 256, 5)), "#fff", "#ABCD", "#12345678", "#ff0000", *sorted(hexes)[:400]]:
        assert hexes[h][0] == color.nearest(h, points), h
    brute = d.select(color.six_digits("hex").alias("six")).distinct().withColumn("c", color.rgb("six")).withColumn("l", color.hsl(F.col("c"))).crossJoin(color.name_table(d, NAMES))
    best = brute.groupBy("six").agg(F.min(F.struct(color.distance(F.col("c"), F.col("l"), F.col("n_rgb"), F.col("n_hsl")).cast("long").alias("d"), "name")).alias("b"))
    want = d.select("hex", color.six_digits("hex").alias("six")).join(best, "six").select("hex", "b.name", "b.d")
    assert sorted((r["hex"], r["color_name"], r["color_distance"]) for r in got) == sorted(tuple(r) for r in want.collect())


def test_few_comparisons_a_color(spark, sf):
    d = colors_of(spark, sf)
    found = color.distinct_colors(d, "hex")
    n = found.join(color.cell_names(found, color.name_table(d, NAMES)), "_cell").count()
    assert n / found.count() < 50


def test_unreadable_empty_and_null(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "#zzzzzz"), (4, "#FF0000")], "id int, hex string")
    got = {r["id"]: r["color_distance"] for r in color.nearest_name(d, "hex").collect()}
    assert got[1] is None and got[2] is None and got[4] == 0 and len(got) == 4
    assert color.nearest_name(d.filter("id < 0"), "hex").count() == 0


def test_a_table_that_is_too_long_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "names.csv").write_text("#ff0000,Red\n#00ff00,Lime\n,None\n")
    assert readers.color_names(spark, str(tmp_path / "names.csv")) == {"FF0000": "Red", "00FF00": "Lime"}
    monkeypatch.setattr(readers, "MOST_NAMES", 2)
    try:
        readers.color_names(spark, str(tmp_path / "names.csv"))
    except ValueError as e:
        assert "colour names" in str(e)
    else:
        raise AssertionError
