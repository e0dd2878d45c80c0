"""Composites of scenes and grids by site and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: first and last day of the year of each composite period; they overlap, and winter wraps
PERIODS = {"0": (335, 59), "1": (60, 151), "2": (152, 243), "3": (244, 334), "gs": (121, 273)}
# fixed values: the bands of each sensor generation in the names of the latest
HARMONISED = {"early": {"B1": "B2", "B2": "B3", "B3": "B4", "B4": "B5", "B5": "B6", "B7": "B7", "B6": "B10"}, "late": {b: b for b in ("B2", "B3", "B4", "B5", "B6", "B7", "B10")}}
EARLY = ("LANDSAT_4", "LANDSAT_5", "LANDSAT_7")


def in_period(day: Column, first: int, last: int) -> Column:
    """Inclusive at both ends; wraps over the new year if it ends before it begins."""
    return (day >= first) & (day <= last) if first <= last else (day >= first) | (day <= last)


def by_period(df: DataFrame, date: str, periods: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A row for each period that a row's day falls in: none, one or several."""
    d = F.dayofyear(date)
    named = F.array(*[F.when(in_period(d, a, z), F.lit(k)) for k, (a, z) in (periods or PERIODS).items()])
    return df.withColumn("period", F.explode(F.array_compact(named)))


def composite(df: DataFrame, by: list[str], columns: list[str], date: str, periods: dict[str, tuple[int, int]] | None = None, fill: float | None = None) -> DataFrame:
    """One row a key: ``<column>_mean_<period>`` and ``<column>_stdDev_<period>`` over the rows of each period."""
    names = list(periods or PERIODS)
    aggs = [f(c).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("stdDev", F.stddev_pop))]
    wide = by_period(df, date, periods).groupBy(*by).pivot("period", names).agg(*aggs)
    out = wide.select(*by, *[F.col(f"{p}_{c}_{s}").alias(f"{c}_{s}_{p}") for c in columns for s in ("mean", "stdDev") for p in names])
    return out.fillna(fill, [c for c in out.columns if c not in by]) if fill is not None else out


def harmonised(df: DataFrame, spacecraft: str = "spacecraft_id") -> DataFrame:
    """Bands of all sensor generations under the names of the latest; optical bands as reflectance, the thermal one in kelvin."""
    early = F.col(spacecraft).isin(*EARLY)
    back = {new: old for old, new in HARMONISED["early"].items()}
    out = {}
    for band in HARMONISED["late"]:
        dn = F.when(early, F.col(back[band])).otherwise(F.col(band))
        out[band] = dn * 0.00341802 + 149.0 if band == "B10" else dn * 0.0000275 - 0.2
    return df.select(*[c for c in df.columns if not (c.startswith("B") and c[1:].isdigit())], *[v.alias(k) for k, v in out.items()])


def focal_difference(pixels: DataFrame, row: str, col: str, value: str, radius: int, offset: float = 0.5) -> DataFrame:
    """Each pixel's value less the mean of the square of ``radius`` cells around it, plus ``offset``. Every pixel is dealt to the rows around it and summed there by column;
    a moving sum along the row does the rest."""
    dealt = pixels.select(F.col(row), F.col(col), F.col(value).alias("__v"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("__d"))
    upright = dealt.groupBy((F.col(row) + F.col("__d")).alias(row), F.col(col)).agg(F.sum("__v").alias("__s"), F.count("__v").alias("__n"))
    along = Window.partitionBy(row).orderBy(col).rangeBetween(-radius, radius)
    mean = upright.select(row, col, (F.sum("__s").over(along) / F.sum("__n").over(along)).alias("__m"))
    return pixels.join(mean, [row, col]).withColumn("tpi", F.floor(F.col(value) - F.col("__m") + offset)).drop("__m")


def climatology(df: DataFrame, by: list[str], date: str, sums: list[str], means: list[str], months: tuple[int, int]) -> DataFrame:
    """Sums and means over a range of months that may wrap."""
    m = F.month(date)
    keep = in_period(m, *months)
    return df.where(keep).groupBy(*by).agg(*[F.sum(c).alias(f"{c}_sum") for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in means])


def yearly_extremes(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Mean, maximum and deviation over years of each year's maximum."""
    years = df.groupBy(*by, F.year(date).alias("__y")).agg(F.max(value).alias("__m"))
    return years.groupBy(*by).agg(F.avg("__m").alias("mean"), F.max("__m").alias("max"), F.stddev_pop("__m").alias("stdDev"))


def frequent_years(df: DataFrame, by: list[str], year: str, hit: Column, least: int = 5, first: int = 1997, last: int = 2020) -> DataFrame:
    """(by, n, frequent): the number of years that hit, years beyond the record counted as its nearest."""
    y = F.greatest(F.least(F.col(year), F.lit(last)), F.lit(first))
    return df.where(hit).groupBy(*by).agg(F.count_distinct(y).alias("n")).withColumn("frequent", F.col("n") >= least)


def masked_means(df: DataFrame, by: list[str], value: str, masks: dict[str, Column]) -> DataFrame:
    """The mean under each mask, in one pass."""
    return df.groupBy(*by).agg(*[F.avg(F.when(m, F.col(value))).alias(k) for k, m in masks.items()])


def remapped(c: Column, table: dict[int, int], other: int | None = None) -> Column:
    """Class codes by a table; codes that it lacks become ``other``."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(m, c.cast("int"))
    return found if other is None else F.coalesce(found, F.lit(other))


def decoded_days(days: Column, origin: str) -> Column:
    """Date of a number of days since ``origin``."""
    return F.date_add(F.lit(origin).cast("date"), days.cast("int"))


def cell_series(cells: DataFrame, points: DataFrame, x: str, y: str, width: float, key: list[str], order: list) -> DataFrame:
    """The series of the cell nearest to each point of a regular grid, one row a time, the first of repeated ones.

    Where the key and the order are the points' and the cells' own columns, the first row of each cell is found before the join, so repeated rows of a cell do not meet its points.
    """
    at = lambda c: F.bround(F.col(c) / width).cast("long")
    grid = cells.withColumn("__i", at("x")).withColumn("__j", at("y")).drop("x", "y")
    own, named = [k for k in key if k in grid.columns], [c for c in order if isinstance(c, str)]
    if len(named) == len(order) and set(named) <= set(grid.columns) and all((k in grid.columns) != (k in points.columns) for k in key):
        rest = F.struct(*named, *[c for c in grid.columns if c not in (*named, *own, "__i", "__j")])
        nearest = grid.groupBy("__i", "__j", *own).agg(F.min_by(rest, F.struct(*named)).alias("__c"))
        grid = nearest.select("__i", "__j", *own, "__c.*")
    both = points.withColumn("__i", at(x)).withColumn("__j", at(y)).join(grid, ["__i", "__j"]).drop("__i", "__j")
    w = Window.partitionBy(*key).orderBy(*order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def complete_sites(frames: list[DataFrame], by: str, date: str) -> DataFrame:
    """Tables joined on every date that any has; sites with an unknown value on any date go."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, [by, date], "full")
    values = [c for c in out.columns if c not in (by, date)]
    lacking = sum((F.col(c).isNull().cast("int") for c in values), F.lit(0))
    bad = out.groupBy(by).agg(F.sum(lacking).alias("__n")).where("__n > 0").select(by)
    return out.join(bad, by, "left_anti")


def dated_columns(df: DataFrame, ids: list[str], pattern: str = r"(.+)_(\d{8})$") -> DataFrame:
    """(ids, variable, date, value) of columns named ``<variable>_<yyyymmdd>``."""
    import re

    found = [c for c in df.columns if re.match(pattern, c)]
    long = df.unpivot(ids, found, "__name", "value").where("value is not null")
    return long.select(*ids, F.regexp_extract("__name", pattern, 1).alias("variable"), F.to_date(F.regexp_extract("__name", pattern, 2), "yyyyMMdd").alias("date"), "value")


def masked_positions(length: int, share: float, kind: str, key: Column, seed: int = 42) -> Column:
    """array<boolean>: hidden positions of a series, drawn by MD5 of key, seed and place and so the same everywhere. speckled: single ones; patch: one run; end: the last ones; mixed: by key one of these."""
    n = max(1, round(length * share))
    draw = lambda *x: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), *[v.cast("string") for v in x])), 1, 12), 16, 10).cast("long") % 1_000_000
    pos = F.sequence(F.lit(0), F.lit(length - 1))
    begin = F.floor(draw(F.lit("p")) * (length - n + 1) / 1_000_000)
    speckled = F.transform(pos, lambda i: draw(i) < int(share * 1_000_000))
    patch = F.transform(pos, lambda i: (i >= begin) & (i < begin + n))
    end = F.transform(pos, lambda i: i >= length - n)
    if kind == "mixed":
        k = draw(F.lit("k")) % 3
        return F.when(k == 0, speckled).when(k == 1, patch).otherwise(end)
    return {"speckled": speckled, "patch": patch, "end": end}[kind]


def radar_climatology(scenes: DataFrame, by: list[str], date: str, years: tuple[int, int] = (2015, 2024), mode: str = "IW") -> DataFrame:
    """Mean and deviation of VV, VH and their ratio over the scenes (polarisations array, mode, VV, VH) of the years that have both polarisations and this mode."""
    both = F.array_contains("polarisations", "VV") & F.array_contains("polarisations", "VH")
    rows = scenes.where(both & (F.col("mode") == mode) & F.year(date).between(*years)).withColumn("VH_VV", F.try_divide("VH", "VV"))
    return rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{s}") for c in ("VV", "VH", "VH_VV") for s, f in (("mean", F.avg), ("stdDev", F.stddev_pop))])


def slope_aspect(pixels: DataFrame, row: str, col: str, value: str, size: float) -> DataFrame:
    """Adds slope and aspect in degrees, from the differences across a pixel of ``size`` metres; rows count southwards, aspect clockwise from north, downhill.
    Null where a neighbour is missing; aspect is null where it is level."""
    along, across = Window.partitionBy(row).orderBy(col), Window.partitionBy(col).orderBy(row)
    near = lambda f, at, w: F.when(F.abs(f(at).over(w) - F.col(at)) == 1, f(value).over(w))
    rows = pixels.withColumn("__dx", (near(F.lead, col, along) - near(F.lag, col, along)) / (2 * size)).withColumn("__dy", (near(F.lag, row, across) - near(F.lead, row, across)) / (2 * size))
    slope = F.degrees(F.atan(F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2)))
    aspect = F.when(F.col("slope") > 0, F.pmod(F.degrees(F.atan2(-F.col("__dx"), -F.col("__dy"))) + 360, F.lit(360.0)))
    return rows.withColumn("slope", slope).withColumn("aspect", aspect).drop("__dx", "__dy")


def class_of_year(layers: DataFrame, by: list[str], year: str, value: str, asked: int, span: tuple[int, int]) -> DataFrame:
    """(by, value): the class of the asked year, or where that year has none the most frequent one of the ``span`` of years (the smallest of several)."""
    own = layers.where(F.col(year) == asked).groupBy(*by).agg(F.min(value).alias("__own"))
    counts = layers.where(F.col(year).between(*span) & F.col(value).isNotNull()).groupBy(*by, value).count()
    usual = counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("__usual"))
    return own.join(usual, by, "full").select(*by, F.coalesce("__own", "__usual").alias(value))


def scene_means(pixels: DataFrame, site: str, scene: str, date: str, bands: list[str], clear: Column) -> DataFrame:
    """(site, year, name, value): the mean of each band over the clear pixels of each scene, named ``<scene>_<band>``; bands without clear pixels are left out."""
    means = pixels.where(clear).groupBy(site, scene, F.year(date).alias("year")).agg(*[F.avg(b).alias(b) for b in bands])
    long = means.unpivot([site, scene, "year"], bands, "__band", "value").where("value is not null")
    return long.select(site, "year", F.concat_ws("_", scene, "__band").alias("name"), "value")


def ordered_scenes(scenes: DataFrame, by: str, scene: str, cloud: str, at_most: float, pattern: str = r"(\d{8})") -> DataFrame:
    """(by, scene, n): the distinct scenes of little cloud of each site, numbered by the date in their names (those of one day by name)."""
    kept = scenes.where(F.col(cloud) <= at_most).select(by, scene).distinct()
    order = Window.partitionBy(by).orderBy(F.regexp_extract(scene, pattern, 1), scene)
    return kept.withColumn("n", F.row_number().over(order))


def period_statistics(df: DataFrame, by: list[str], date: str, how: dict[str, tuple[str, ...]], periods: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row a key: ``<column>_<statistic>_<period>`` for the statistics (mean, max, min) that each column asks for."""
    names, f = list(periods or PERIODS), {"mean": F.avg, "max": F.max, "min": F.min}
    aggs = [f[s](c).alias(f"{c}_{s}") for c, each in how.items() for s in each]
    return by_period(df, date, periods).groupBy(*by).pivot("period", names).agg(*aggs).select(*by, *[(F.col(f"{p}_{c}_{s}") if len(aggs) > 1 else F.col(p)).alias(f"{c}_{s}_{p}") for c, each in how.items() for s in each for p in names])
