"""Projection, containment, pixels and bands as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: GRS80 ellipsoid and the conic equal-area projection of the conterminous states
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257222101
PARALLELS, ORIGIN = (29.5, 45.5), (-96.0, 23.0)


def _ellipsoid() -> tuple[float, float]:
    f = 1 / INVERSE_FLATTENING
    e2 = f * (2 - f)
    return e2, math.sqrt(e2)


def _q(sin):
    e2, e = _ellipsoid()
    log = math.log if isinstance(sin, float) else F.log
    return (1 - e2) * (sin / (1 - e2 * sin * sin) - log((1 - e * sin) / (1 + e * sin)) * (1 / (2 * e)))


def albers_constants() -> tuple[float, float, float]:
    """(cone constant, C, rho at the origin) in ellipsoid units."""
    e2, _ = _ellipsoid()
    s1, s2, s0 = (math.sin(math.radians(x)) for x in (*PARALLELS, ORIGIN[1]))
    m = [math.cos(math.radians(p)) / math.sqrt(1 - e2 * s * s) for p, s in zip(PARALLELS, (s1, s2), strict=True)]
    n = (m[0] ** 2 - m[1] ** 2) / (_q(s2) - _q(s1))
    c = m[0] ** 2 + n * _q(s1)
    return n, c, math.sqrt(c - n * _q(s0)) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    n, c, rho0 = albers_constants()
    rho = F.sqrt(c - n * _q(F.sin(F.radians(lat)))) / n * SEMI_MAJOR
    angle = n * F.radians(lon - ORIGIN[0])
    return rho * F.sin(angle), rho0 * SEMI_MAJOR - rho * F.cos(angle)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon given as array<struct<x,y>>: an odd number of edges lie to its right. Open and closed rings count alike."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, shifted, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda n, v: n + v) % 2 == 1


def pixel(x: Column, y: Column, left: float, top: float, width: float, height: float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point in a raster of north-up cells."""
    return F.floor((top - y) / height).cast("int"), F.floor((x - left) / width).cast("int")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(a))


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def enhanced_index(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def clear_pixel(qa: Column, saturation: Column, bits: tuple[int, ...] = (1, 2, 3, 4, 5)) -> Column:
    """None of the quality bits is set and nothing is saturated."""
    out = saturation == 0
    for k in bits:
        out = out & (F.shiftright(qa, k).bitwiseAND(1) == 0)
    return out


def surface_reflectance(dn: Column) -> Column:
    return dn * 0.0000275 - 0.2


def texture_percent(sand: Column, silt: Column, clay: Column) -> tuple[Column, Column, Column]:
    """Whole percents that sum to 100, what rounding leaves going to the largest rounded part (sand, silt, clay on a tie); null if any part is or the sum is not positive."""
    total = sand + silt + clay
    ok = (sand >= 0) & (silt >= 0) & (clay >= 0) & (total > 0)
    parts = [F.when(ok, F.bround(F.try_divide(c * 100, total)).cast("int")) for c in (sand, silt, clay)]
    a, b, c = parts
    rest = 100 - a - b - c
    top = [(a >= b) & (a >= c), (b > a) & (b >= c), (c > a) & (c > b)]
    return tuple(F.when(t, p + rest).otherwise(p) for t, p in zip(top, parts, strict=True))


def ternary(sand: Column, clay: Column) -> tuple[Column, Column]:
    """Triangle coordinates of percents: clay upwards, sand to the left."""
    return 100 - sand - clay / 2, clay * (math.sqrt(3) / 2)


# fixed values: lines between the texture classes of three systems, from one (sand, clay, silt) to another
CLASS_LINES = {
    "USA": [
        ((85, 0, 15), (90, 10, 0)), ((70, 0, 30), (85, 15, 0)), ((50, 0, 50), (23, 27, 50)), ((20, 0, 80), (10, 10, 80)), ((10, 10, 80), (0, 10, 90)), ((80, 20, 0), (52, 20, 28)),
        ((52, 20, 28), (45, 27, 28)), ((45, 27, 28), (0, 27, 73)), ((52, 20, 28), (52, 6, 42)), ((52, 6, 42), (44, 6, 50)), ((45, 27, 28), (45, 55, 0)), ((65, 35, 0), (45, 35, 20)),
        ((45, 40, 15), (0, 40, 60)), ((20, 27, 53), (20, 40, 40)), ((20, 40, 40), (0, 60, 40)),
    ],
    "Britain": [
        ((85, 0, 15), (90, 10, 0)), ((70, 0, 30), (85, 15, 0)), ((82, 18, 0), (0, 18, 82)), ((70, 30, 0), (50, 30, 20)), ((50, 30, 20), (50, 0, 50)), ((20, 35, 45), (20, 0, 80)),
        ((0, 55, 45), (20, 35, 45)), ((45, 35, 20), (0, 35, 65)), ((45, 35, 20), (50, 30, 20)), ((45, 35, 20), (45, 55, 0)),
    ],
    "Australia": [
        ((0, 75, 25), (75, 0, 25)), ((35, 40, 25), (0, 40, 60)), ((50, 25, 25), (0, 25, 75)), ((50, 25, 25), (82, 18, 0)), ((35, 40, 25), (72, 28, 0)), ((92, 0, 8), (87, 9, 4)),
        ((91.5, 8.5, 0), (63, 12, 25)), ((76.25, 10.5, 13.25), (50, 50, 0)),
    ],
}


def class_lines(spark: SparkSession) -> DataFrame:
    """(system, line, x0, y0, x1, y1): the lines between texture classes in triangle coordinates."""
    rows = [(s, k, *map(float, (a[0], a[1], b[0], b[1]))) for s, lines in CLASS_LINES.items() for k, (a, b) in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "system string, line int, s0 double, c0 double, s1 double, c1 double")
    (x0, y0), (x1, y1) = ternary(F.col("s0"), F.col("c0")), ternary(F.col("s1"), F.col("c1"))
    return df.select("system", "line", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def side_of(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """1 left of the line from (x0, y0) to (x1, y1), -1 right of it, 0 on it (to a millionth)."""
    return F.signum(F.round((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0), 6)).cast("int")
