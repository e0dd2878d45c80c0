"""Depth levels and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: bounds and nominal depths in cm of the seven levels, exact sensor depths, six map bands
LEVEL_BOUNDS = {1: (0.0, 2.5), 2: (2.5, 10.0), 3: (10.0, 22.5), 4: (22.5, 45.0), 5: (45.0, 80.0), 6: (80.0, 150.0), 7: (150.0, 250.0)}
LEVEL_NOMINAL = {1: 0, 2: 5, 3: 15, 4: 30, 5: 60, 6: 100, 7: 200}
SENSOR_LEVEL = {5: 2, 10: 2, 20: 3, 45: 4, 50: 5, 70: 5, 91: 6, 100: 6}
MAP_BANDS = [(0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200)]


def level(cm: Column) -> Column:
    """The level whose half-open bounds hold the depth; beyond all of them the level of the nearest centre; null for null."""
    out = F.when(cm.isNull(), F.lit(None).cast("int"))
    for k, (lo, hi) in LEVEL_BOUNDS.items():
        out = out.when((cm >= lo) & (cm < hi), k)
    nearest = F.array_min(F.array(*[F.struct(F.abs(cm - (lo + hi) / 2).alias("d"), F.lit(k).alias("k")) for k, (lo, hi) in LEVEL_BOUNDS.items()]))
    return out.otherwise(nearest["k"])


def sensor_level(cm: Column) -> Column:
    """The level of an exact sensor depth, else null."""
    out = None
    for d, k in SENSOR_LEVEL.items():
        out = F.when(cm == d, k) if out is None else out.when(cm == d, k)
    return out


def midpoint(top: Column, bottom: Column) -> Column:
    """Middle of a horizon; the one bound that is known if the other is not."""
    return F.coalesce((top + bottom) / 2, top, bottom)


def band_table(spark: SparkSession) -> DataFrame:
    """(band, lo, hi), six rows."""
    return spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(MAP_BANDS, 1)], "band int, lo double, hi double")


def level_table(spark: SparkSession) -> DataFrame:
    """(level, lo, hi, centre, nominal), seven rows."""
    return spark.createDataFrame([(k, lo, hi, (lo + hi) / 2, LEVEL_NOMINAL[k]) for k, (lo, hi) in LEVEL_BOUNDS.items()], "level int, lo double, hi double, centre double, nominal int")


def suffix_bounds(name: Column) -> tuple[Column, Column]:
    """The two numbers of a name that ends in ``_<from>_<to>`` with or without ``cm``."""
    pattern = r"_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)(?:cm)?$"
    return tuple(F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).cast("double") for k in (1, 2))


def trailing_number(name: Column) -> Column:
    """The whole number at the end of a name, before ``cm`` if there."""
    return F.nullif(F.regexp_extract(name, r"(\d+)(?:cm)?$", 1), F.lit("")).cast("int")
