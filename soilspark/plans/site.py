"""Daily site tables from tower records, and networks' series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import clean, depth, vg
from soilspark.operators import aggregates, series, spatial
from soilspark.sources.files import family


def tower_days(rows: DataFrame, met: tuple[str, ...] = ("WS", "TA", "RH", "VPD")) -> DataFrame:
    """(site_id, date, theta, ET, GPP, met...) of half-hourly ``rows`` (site_id, ts and measured families).

    Soil water in percent becomes a fraction; ET sums the latent heat over the site's usual step; a daily zero of a flux is unknown; days where any flux that
    the site measures is unknown go. Tables without soil water have a null theta.
    """
    swc, le, gpp = (family(rows, p) for p in ("SWC", "LE", "GPP"))
    mean = lambda cols: aggregates.row_mean([F.col(c).cast("double") for c in cols]) if cols else F.lit(None).cast("double")
    step = aggregates.modal_step(rows, ["site_id"], "ts")
    wide = rows.join(step, "site_id", "left").select(
        "site_id", "ts", mean(swc).alias("theta"), clean.et_from_latent_heat(mean(le), F.col("step")).alias("ET"), mean(gpp).alias("GPP"), *[mean(family(rows, m)).alias(m) for m in met if family(rows, m)]
    )
    wide = clean.percent_to_fraction(wide, "theta", ["site_id"])
    means = [c for c in wide.columns if c not in ("site_id", "ts", "ET")]
    days = wide.groupBy("site_id", F.to_date("ts").alias("date")).agg(*[F.avg(c).alias(c) for c in means], F.sum("ET").alias("ET"))
    fluxes = [c for c, cols in (("ET", le), ("GPP", gpp)) if cols]
    days = days.withColumns({c: F.nullif(c, F.lit(0.0)) for c in fluxes})
    return days.na.drop("any", subset=fluxes) if fluxes else days


def with_suction(days: DataFrame, params: DataFrame, key: str = "site_id") -> DataFrame:
    """Adds psi_cm of theta by the site's parameters (one row a site)."""
    return days.join(params.select(key, *vg.PARAMS), key, "left").withColumn("psi_cm", vg.psi(F.col("theta"), *[F.col(p) for p in vg.PARAMS])).drop(*vg.PARAMS)


def network_days(raw: DataFrame, good: str = "G", window: tuple[float, float] | None = None) -> DataFrame:
    """(station, date, depth_cm, theta) of records with depth_from and depth_to in metres and a quality flag: the mean of good records, of all where none is good, over all sensors of a depth.
    Records without any depth go, and with a ``window`` in centimetres those whose middle lies outside it."""
    mid = F.bround(depth.midpoint(F.col("depth_from"), F.col("depth_to")) * 100).cast("int")
    rows = raw.withColumn("depth_cm", mid).withColumn("date", F.to_date("date_time")).where("depth_cm is not null")
    rows = rows if window is None else rows.where(F.col("depth_cm").between(*window))
    return series.prefer_flagged(rows, ["station", "date", "depth_cm"], "soil_moisture", "soil_moisture_flag", good).withColumnRenamed("soil_moisture", "theta")


def station_table(raw: DataFrame) -> DataFrame:
    """One row a station: the first known attributes, the number of its depths, first and last day."""
    mid = F.bround(depth.midpoint(F.col("depth_from"), F.col("depth_to")), 4)
    attributes = aggregates.first_known(raw, ["station"], ["network", "latitude", "longitude"], "date_time").drop("n")
    extent = raw.groupBy("station").agg(F.count_distinct(mid).alias("depths"), F.min(F.to_date("date_time")).alias("start"), F.max(F.to_date("date_time")).alias("stop"))
    return attributes.join(extent, "station")


def site_table(raw: DataFrame, key: str, lon: str, lat: str, attributes: list[str], order: str, tiles: DataFrame | None = None) -> DataFrame:
    """One row a site: its coordinates, the first known value of each attribute, and with ``tiles`` (tile, ring) the tile that holds it, null outside all.

    Two rows of a site with different coordinates are an error.
    """
    extent = raw.groupBy(key).agg(F.count_distinct(F.struct(lon, lat)).alias("n")).where("n > 1").limit(1).collect()
    if extent:
        raise ValueError(f"{key} {extent[0][key]} has several coordinates")
    out = aggregates.first_known(raw, [key], [lon, lat, *attributes], order).drop("n")
    return out if tiles is None else spatial.within(out, tiles, lon, lat, how="left")


def content_by_depth(days: DataFrame, curves: DataFrame, by: str, scale: float = 0.01, width: float = 0.05) -> DataFrame:
    """(by, depth_cm, bin, n, share): how often each water content was measured at the depths that retention curves are known of.

    ``days`` has columns ``soil_vwc_<cm>`` in percent; ``curves`` (by, depth_cm); contents beyond 0 and 1 are left out; depths are compared as whole centimetres.
    """
    names = [c for c in days.columns if re.fullmatch(r"soil_vwc_\d+", c)]
    long = days.unpivot([by], names, "__name", "theta").select(by, F.regexp_extract("__name", r"(\d+)$", 1).cast("int").alias("depth_cm"), (F.col("theta") * scale).alias("theta"))
    wanted = curves.select(by, F.bround("depth_cm").cast("int").alias("depth_cm")).distinct()
    seen = long.where(F.col("theta").between(0, 1)).join(wanted, [by, "depth_cm"])
    counts = seen.groupBy(by, "depth_cm", F.floor(F.round(F.col("theta") / width, 9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(by, "depth_cm").agg(F.sum("n").alias("__n"))
    return counts.join(total, [by, "depth_cm"]).select(by, "depth_cm", "bin", "n", (F.col("n") / F.col("__n")).alias("share"))


def wide_days(days: DataFrame, depths: list[int]) -> DataFrame:
    """A column ``soil_vwc_<cm, four digits>`` for each depth."""
    wide = days.groupBy("station", "date").pivot("depth_cm", depths).agg(F.avg("theta"))
    return wide.withColumnsRenamed({str(d): f"soil_vwc_{d:04d}" for d in depths})
