"""Comparison of parameter sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soilspark.functions import depth, vg
from soilspark.operators import joins, metrics
from soilspark.operators.quantiles import quantiles


def side_by_side(sources: dict[str, DataFrame], by: list[str], params: list[str]) -> DataFrame:
    """Rows of the first source with ``<param>_<source>`` of each; others are joined where they have the key."""
    out = None
    for name, df in sources.items():
        one = df.select(*by, *[F.col(p).alias(f"{p}_{name}") for p in params])
        out = one if out is None else out.join(one, by, "left")
    return out


def agreement(both: DataFrame, base: str, others: list[str], params: list[str], by: list[str]) -> DataFrame:
    """(by, param, other, n, r2 ...): each other source against the base for each parameter, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(o).alias("other"), F.col(f"{p}_{base}").alias("y"), F.col(f"{p}_{o}").alias("p")) for p in params for o in others]))
    return both.select(*by, each.alias("m")).select(*by, "m.*").groupBy(*by, "param", "other").agg(*metrics.regression_metrics(F.col("y"), F.col("p")))


def by_level(fits: DataFrame, key: str, at: str = "depth_cm") -> DataFrame:
    """Of the fits of a station at several depths the one nearest to the centre of each level that they lie in (of two as near the upper one), with level and centre."""
    rows = fits.withColumn("level", depth.level(F.col(at))).where("level is not null")
    rows = rows.join(F.broadcast(depth.level_table(fits.sparkSession).select("level", "centre")), "level")
    return joins.first_row(rows, [key, "level"], [F.abs(F.col(at) - F.col("centre")), F.col(at)])


def stations_side_by_side(fits: DataFrame, modelled: DataFrame, mapped: DataFrame, key: str, at: str = "depth_cm") -> DataFrame:
    """(key, level, depth, <parameter>_station, _modelled, _mapped): fitted curves of stations beside a model's by level (key, level, parameters) and a map's
    by band (key, lo, hi, parameters; the band that holds the level's centre). Sources that lack a station or level leave nulls."""
    own = by_level(fits, key, at)
    base = own.select(key, "level", "centre", at, *[F.col(p).alias(f"{p}_station") for p in vg.PARAMS])
    other = modelled.select(key, "level", *[F.col(p).alias(f"{p}_modelled") for p in vg.PARAMS])
    bands = mapped.select(F.col(key).alias("__key"), "lo", "hi", *[F.col(p).alias(f"{p}_mapped") for p in vg.PARAMS])
    both = base.join(other, [key, "level"], "left")
    held = (both[key] == bands["__key"]) & (both["centre"] >= bands["lo"]) & (both["centre"] < bands["hi"])
    return both.join(bands, held, "left").drop("__key", "lo", "hi", "centre")


def distributions(sources: dict[str, DataFrame], by: list[str], value: str) -> DataFrame:
    """(source, by, n, p10, p50, p90) of the known values."""
    out = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), *by, value)
        out = one if out is None else out.unionByName(one)
    got = quantiles(out, ["source", *by], value, [0.1, 0.5, 0.9])
    return got.select("source", *by, "n", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("p10", "p50", "p90"))])


def influence(params: DataFrame, name: str, points: int = 100, decades: float = 5.0) -> DataFrame:
    """(stat, i, psi, theta): the curve at ``points`` suctions with one parameter at its mean and its 10, 50 and 90 % quantiles, the others at their means."""
    means = params.agg(*[F.avg(p).alias(p) for p in vg.PARAMS])
    stats = means.crossJoin(quantiles(params, [], name, [0.1, 0.5, 0.9]).select(F.col("q").alias("__q")))  # a row each
    options = F.array(F.struct(F.lit("mean").alias("stat"), F.col(name).alias("v")), *[F.struct(F.lit(s).alias("stat"), F.get("__q", F.lit(k)).alias("v")) for k, s in enumerate(("p10", "p50", "p90"))])
    rows = stats.select(*[p for p in vg.PARAMS if p != name], F.inline(options)).withColumnRenamed("v", name)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("psi", F.pow(F.lit(10.0), F.col("i") * decades / (points - 1)))
    return rows.withColumn("theta", vg.theta(F.col("psi"), *[F.col(p) for p in vg.PARAMS]))


def ledger(sites: DataFrame, rows: DataFrame, key: str, least: int) -> DataFrame:
    """Every site with its number of rows, whether it can be built, and if not why."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = sites.join(n, key, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < least, "skipped").otherwise("built")
    reason = F.when(F.col("n").isNull(), "no observations").when(F.col("n") < least, f"fewer than {least} observations")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), reason.alias("reason"))


def blank_repeats(rows: DataFrame, by: str, order: str, out: str) -> DataFrame:
    """Adds the label for display: empty where the row before has the same."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn(out, F.when(F.row_number().over(w) == 1, F.col(by)).otherwise(""))
