"""Colours: hex forms, RGB, HSL, distance and the nearest name."""

from __future__ import annotations

from colorsys import rgb_to_hls
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import bound, col
from webloom.sources.shared import saved

CSS_HEX = "#[0-9a-fA-F]{3,8}"


def six_digits(hex_: Column | str) -> Column:
    """Upper case, without ``#``; 3 or 4 digits doubled, longer forms cut to 6."""
    h = F.regexp_replace(F.upper(col(hex_)), "^#", "")
    twice = F.concat(*(F.repeat(F.substring(h, i, 1), 2) for i in (1, 2, 3)))
    return F.when(F.char_length(h).isin(3, 4), twice).otherwise(F.substring(h, 1, 6))


def is_valid_color(x: Column | str) -> Column:
    return F.startswith(col(x), F.lit("#")) & F.char_length(col(x)).isin(4, 7, 9)


def rgb(hex_: Column | str) -> Column:
    h = six_digits(hex_)
    return F.struct(*(F.conv(F.substring(h, at, 2), 16, 10).cast("int").alias(n) for n, at in (("r", 1), ("g", 3), ("b", 5))))


def hsl(c: Column) -> Column:
    """From an rgb struct; degrees and per cent, cut to whole numbers."""
    r, g, b = (c[n].cast("double") / 255.0 for n in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (top + low) / 2, top - low
    flat = top == low
    s = F.when(flat, 0.0).when(light > 0.5, d / (2.0 - top - low)).otherwise(d / (top + low))
    turn = F.when(top == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    hue = F.when(flat, 0.0).otherwise(turn / 6.0)
    whole = lambda x: F.floor(x).cast("int")
    return F.struct(whole(hue * 360).alias("h"), whole(s * 100).alias("s"), whole(light * 100).alias("l"))


def distance(a: Column, ha: Column, b: Column, hb: Column) -> Column:
    """Squared RGB distance plus twice the squared HSL distance."""
    square = lambda x, y: (x - y) * (x - y)
    return sum(square(a[n], b[n]) for n in "rgb") + 2 * sum(square(ha[n], hb[n]) for n in "hsl")


def is_dark(c: Column) -> Column:
    return (c["r"] * 299 + c["g"] * 587 + c["b"] * 114) / 1000 < 128


def name_table(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(name_hex, name, n_rgb, n_hsl) of a table of names: a parameter of fixed size, so it may be broadcast."""
    table = df.sparkSession.createDataFrame(sorted((names or fixed.COLOR_NAMES).items()), "name_hex string, name string")
    return table.withColumn("n_rgb", rgb("name_hex")).withColumn("n_hsl", hsl(F.col("n_rgb")))


#: Steps of the lattice: of each RGB channel, and of the hue, whose jumps would blur a cell.
CELL, HUES = 16, 24


def cell_names(colors: DataFrame, names: DataFrame) -> DataFrame:
    """(_cell, name, n_rgb, n_hsl): for each occupied cell of the lattice the names that can be nearest to a colour in it.

    ``colors`` has ``_cell``, ``_rgb`` and ``_hsl``. A cell's box is what its colours span. A name that is farther from the
    nearest point of the box than another name from the farthest point can't win there. Cells are at most some thousands and the
    table of names is a parameter of fixed size, so this costs the same however many colours there are.
    """
    axes = [(f"_{kind}", n, f"n_{kind}", weight) for kind, weight in (("rgb", 1), ("hsl", 2)) for n in kind]
    spans = (f(F.col(c)[n]).alias(f"_{n}_{w}") for c, n, _, _ in axes for w, f in (("low", F.min), ("high", F.max)))
    boxes = colors.filter(F.col("_cell").isNotNull()).groupBy("_cell").agg(*spans)
    gaps = {
        "least": lambda x, low, high: F.greatest(low - x, x - high, F.lit(0)),
        "most": lambda x, low, high: F.greatest(F.abs(x - low), F.abs(x - high)),
    }
    bound = lambda w: sum((g := gaps[w](F.col(t)[n], F.col(f"_{n}_low"), F.col(f"_{n}_high"))) * g * k for _, n, t, k in axes)
    pairs = boxes.crossJoin(F.broadcast(names))
    safe = pairs.groupBy("_cell").agg(F.min(bound("most")).alias("_enough"))
    return boxes.join(safe, "_cell").crossJoin(F.broadcast(names)).filter(bound("least") <= F.col("_enough")).select("_cell", "name", "n_rgb", "n_hsl")


def distinct_colors(df: DataFrame, hex_: str) -> DataFrame:
    """(_hex, _rgb, _hsl, _cell) of each colour once; the cell is null where the digits can't be read."""
    step = lambda c, n, width: F.floor(c[n] / width).cast("long")
    cell = lambda c, h: ((step(c, "r", CELL) * 256 + step(c, "g", CELL)) * 256 + step(c, "b", CELL)) * 512 + step(h, "h", HUES)
    point = bound(rgb("_hex"), lambda c: bound(hsl(c), lambda h: F.struct(c.alias("_rgb"), h.alias("_hsl"), cell(c, h).alias("_cell"))))
    return df.select(six_digits(hex_).alias("_hex")).distinct().withColumn("_point", point).select("_hex", "_point.*")


def nearest_name(df: DataFrame, hex_: str, names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``color_name`` and ``color_distance`` of the nearest name; ties go to the first name in order, and colours
    whose digits can't be read have neither.

    Distinct colours are written once, as they are read twice; they meet, by their cell of a lattice, only the few names that can win there (:func:`cell_names`).
    """
    colors = saved(distinct_colors(df, hex_), "colors")
    pairs = colors.join(cell_names(colors, name_table(df, names)), "_cell")
    d = distance(F.col("_rgb"), F.col("_hsl"), F.col("n_rgb"), F.col("n_hsl")).cast("long")
    best = pairs.withColumn("d", d).groupBy("_hex").agg(F.min(F.struct("d", "name")).alias("best"))
    best = best.select("_hex", F.col("best.name").alias("color_name"), F.col("best.d").alias("color_distance"))
    return df.withColumn("_hex", six_digits(hex_)).join(best, "_hex", "left").drop("_hex")


def named_points(names: dict[str, str] | None = None) -> list[tuple]:
    """(name, r, g, b, h, s, l) of a table of names, in the order that breaks ties."""
    return sorted((name, *point(hex_)) for hex_, name in (names or fixed.COLOR_NAMES).items())


@lru_cache(4096)
def point(hex_: str) -> tuple[int, ...]:
    """r, g, b, h, s, l of a hex colour, as :func:`rgb` and :func:`hsl` give them; zeros where there are too few digits."""
    x = hex_.upper().removeprefix("#")
    x = "".join(c + c for c in x[:3]) if len(x) in (3, 4) else x[:6]
    r, g, b = (int(x[k : k + 2] or "0", 16) for k in (0, 2, 4))
    h, l, s = rgb_to_hls(r / 255, g / 255, b / 255)  # noqa: E741
    return r, g, b, int(h * 360), int(s * 100), int(l * 100)


def nearest(hex_: str, points: list[tuple]) -> str:
    """The name of the nearest colour, where a page is in a worker's hands already; see :func:`nearest_name`."""
    own = point(hex_)
    return min(points, key=lambda p: (sum((a - b) ** 2 * (1 if k < 3 else 2) for k, (a, b) in enumerate(zip(own, p[1:], strict=True))), p[0]))[0]


def css_colors(css: Column | str) -> Column:
    return F.regexp_extract_all(col(css), F.lit(CSS_HEX), F.lit(0))


def brand_colors(css: Column | str) -> Column:
    """Valid colours of style sheets, lower-cased, each once in order; black where there is none."""
    found = F.array_distinct(F.filter(F.transform(css_colors(css), F.lower), is_valid_color))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("#000000")))


def merged_colors(first: Column | str, second: Column | str) -> Column:
    """Both lists in order, each colour once regardless of case."""
    both = F.concat(F.coalesce(col(first), F.array().cast("array<string>")), F.coalesce(col(second), F.array().cast("array<string>")))
    return F.array_distinct(F.transform(both, F.lower))
