"""Spatial joins without a geometry type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soilspark.functions import geo


def within(points: DataFrame, polygons: DataFrame, x: str, y: str, how: str = "inner", ring: str = "ring", max_broadcast: int = 20_000, cell: float = 1.0) -> DataFrame:
    """Points with the polygons that hold them. Bounding boxes come first.

    A checked number of polygons is broadcast; more are dealt, as the points are, to the grid cells that their boxes touch and joined there.
    """
    span = lambda c, f: f(F.transform(ring, lambda p: p[c]))
    boxed = polygons.withColumns({"__x0": span("x", F.array_min), "__x1": span("x", F.array_max), "__y0": span("y", F.array_min), "__y1": span("y", F.array_max)})
    inside = F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")) & geo.in_ring(F.col(x), F.col(y), F.col(ring))
    extra = ["__x0", "__x1", "__y0", "__y1"]
    if polygons.limit(max_broadcast + 1).count() <= max_broadcast:
        return points.join(F.broadcast(boxed), inside, how).drop(*extra, ring)
    at = lambda c: F.floor(c / cell)
    tiles = boxed.withColumn("__cx", F.explode(F.sequence(at(F.col("__x0")), at(F.col("__x1"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("__y0")), at(F.col("__y1")))))
    dealt = points.withColumn("__px", at(F.col(x))).withColumn("__py", at(F.col(y)))
    return dealt.join(tiles, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & inside, how).drop(*extra, ring, "__cx", "__cy", "__px", "__py")


def sampled(points: DataFrame, pixels: DataFrame, x: str, y: str, left: float, top: float, width: float, height: float) -> DataFrame:
    """Points with the pixels (row, col, value ...) they lie in."""
    row, col = geo.pixel(F.col(x), F.col(y), left, top, width, height)
    return points.withColumn("row", row).withColumn("col", col).join(pixels, ["row", "col"])


def quadrants(points: DataFrame, tile: str, x: str, y: str, most: int, depth: int = 12) -> DataFrame:
    """``points`` with ``part``: their tile, split into quarters again and again until a part holds at most ``most`` points (or ``depth`` times, for points in one place).

    A tile is the box of its points. A part is named by its tile and a digit for each split: 0 south-west, 1 south-east, 2 north-west, 3 north-east; a tile that is small enough keeps its name.
    Points are counted by their deepest cell, and these counts, not the points, by all the parts above. Points without tile or place have no part.
    """
    box = points.groupBy(tile).agg(*[f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = points.join(box, tile, "left")
    side = 1 << depth

    def cell(c: str) -> Column:
        width = F.col(f"__hi{c}") - F.col(f"__lo{c}")
        return F.least(F.floor(F.when(width > 0, (F.col(c) - F.col(f"__lo{c}")) / width).otherwise(0.0) * side), F.lit(side - 1)).cast("int")

    bit = lambda c, k: F.shiftright(c, depth - k).bitwiseAND(1)
    digits = F.concat(*[(bit(F.col("__i"), k) + 2 * bit(F.col("__j"), k)).cast("string") for k in range(1, depth + 1)])
    placed = F.col(tile).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = rows.withColumns({"__i": cell(x), "__j": cell(y)}).withColumn("__cell", F.when(placed, digits)).drop("__i", "__j", *[f"__{n}{c}" for c in (x, y) for n in ("lo", "hi")])
    cells = rows.where("__cell is not null").groupBy(tile, "__cell").agg(F.count("*").alias("__n"))
    above = cells.select(tile, "__cell", "__n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("__k")).withColumn("__p", F.substr("__cell", F.lit(1), F.col("__k")))
    small = above.groupBy(tile, "__p").agg(F.sum("__n").alias("__m")).where((F.col("__m") <= most) | (F.char_length("__p") == depth))
    first = above.select(tile, "__cell", "__p").join(small, [tile, "__p"]).groupBy(tile, "__cell").agg(F.min_by("__p", F.char_length("__p")).alias("__p"))
    part = F.when(F.col("__p") == "", F.col(tile).cast("string")).otherwise(F.concat_ws("-", F.col(tile).cast("string"), "__p"))
    return rows.join(first, [tile, "__cell"], "left").withColumn("part", F.when(F.col("__p").isNotNull(), part)).drop("__cell", "__p")
