"""Aggregations by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilspark.sources.scratch import kept


def first_known(df: DataFrame, by: list[str], columns: list[str], order: str, empty: tuple = ()) -> DataFrame:
    """For each key the first non-null value of each column by ``order``; values in ``empty`` count as null. Also n, the number of rows."""

    def one(c: str) -> Column:
        v = F.when(~F.col(c).isin(*empty), F.col(c)) if empty else F.col(c)
        return F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(c)

    return df.groupBy(*by).agg(*[one(c) for c in columns], F.count("*").alias("n"))


def coverage_class(least: Column, most: Column, wet: float = 150.0, dry: float = 14000.0) -> Column:
    """YWYD, YWND, NWYD or NWND: whether observations reach the wet and the dry end."""
    return F.concat(F.when(least <= wet, "YW").otherwise("NW"), F.when(most >= dry, "YD").otherwise("ND"))


def row_mean(columns: list[Column]) -> Column:
    """Mean of the known values of a row; null without any."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.size(known))


def known_per_row(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def standardised(df: DataFrame, column: str, by: list[str], out: str, floor: float = 1e-6) -> DataFrame:
    """z-scores with the population deviation, kept from zero by ``floor``."""
    s = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(s, by).withColumn(out, (F.col(column) - F.col("__m")) / (F.col("__s") + floor)).drop("__m", "__s")


def repeated_to_null(df: DataFrame, column: str, by: list[str], n: int = 30, digits: int = 4) -> DataFrame:
    """A value that occurs ``n`` times or more in its group, after rounding, is a filler and becomes null."""
    r = F.bround(F.col(column), digits)
    often = df.groupBy(*by, r.alias("__r")).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).where("__r is not null").drop("__n").withColumn("__often", F.lit(True))
    return df.withColumn("__r", r).join(often, [*by, "__r"], "left").withColumn(column, F.when(F.col("__often").isNull(), F.col(column))).drop("__r", "__often")


def modal_step(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """The most frequent difference in seconds between consecutive times, the smaller of two."""
    w = Window.partitionBy(*by).orderBy(at)
    steps = df.select(*by, F.unix_timestamp(F.col(at).cast("timestamp")).alias(at)).distinct().withColumn("step", F.col(at) - F.lag(at).over(w)).where("step is not null")
    counts = steps.groupBy(*by, "step").count()
    return counts.groupBy(*by).agg(F.min_by("step", F.struct(-F.col("count"), F.col("step"))).alias("step"))


def weighted_mean_vector(df: DataFrame, by: list[str], vector: str, weight: Column, floor: float = 1e-6) -> DataFrame:
    """(by, pos, value): the weighted mean of each component; weights are at least ``floor``."""
    w = F.greatest(weight.cast("double"), F.lit(floor))
    each = df.select(*by, w.alias("__w"), F.posexplode(vector).alias("pos", "__v"))
    return each.groupBy(*by, "pos").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("value"))


def mode_value(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """The most frequent known value, the smallest of several."""
    c = df.where(F.col(column).isNotNull()).groupBy(*by, column).count()
    return c.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias(out))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, density) over equal bins, the last one closed."""
    width = (hi - lo) / bins
    inside = df.where(F.col(column).between(lo, hi))
    b = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = inside.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


FINE = 64  # bins to a kernel's width
REACH = 8  # widths beyond which a kernel adds less than a double can show


def kernel_density(df: DataFrame, by: list[str], value: str, points: int = 100, margin: float = 3.0) -> DataFrame:
    """(by, i, x, density): Gaussian kernel densities at ``points`` places from ``margin`` widths below a group's least value to as many above its largest.

    The width is n^(-1/5) sample deviations. Values are counted in bins of a ``FINE``-th of it, each with the mean of its values, and the counts are folded with the kernel at the places within
    ``REACH`` widths, so the work after the counting does not grow with the rows. A group of less than two different known values has no density. Widths are written once and read by all that
    follows: computed anew they differ in their last digits with the order in which parts arrive, and places would not meet.
    """
    known = F.col(value).cast("double")
    rows = df.select(*by, known.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("__n"), (F.stddev_samp("__v") * F.pow(F.count("*"), F.lit(-0.2))).alias("__h"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).where("__h > 0")
    stats = kept(stats, "widths")
    r = stats.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(r[f"__{c}"])
    at = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__h") / FINE))
    own = ["__n", "__h", "__lo", "__hi"]
    bins = rows.join(r, same).groupBy(*by, *own, at.alias("__bin")).agg(F.count("*").alias("__c"), F.avg("__v").alias("__m"))
    begin = F.col("__lo") - margin * F.col("__h")
    step = (F.col("__hi") - F.col("__lo") + 2 * margin * F.col("__h")) / (points - 1)
    reached = lambda side, f: f((F.col("__m") + side * REACH * F.col("__h") - begin) / step).cast("int")
    places = F.sequence(F.greatest(F.lit(0), reached(-1, F.ceil)), F.least(F.lit(points - 1), reached(1, F.floor)))
    each = bins.withColumn("i", F.explode(places)).withColumn("x", begin + F.col("i") * step)
    u = (F.col("x") - F.col("__m")) / F.col("__h")
    folded = each.groupBy(*by, *own, "i", "x").agg(F.sum(F.col("__c") * F.exp(-u * u / 2)).alias("__s"))
    grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", begin + F.col("i") * step)  # places that no value reaches are 0
    every = grid.select(*by, *own, "i", "x", F.lit(0.0).alias("__s")).unionByName(folded)
    return every.groupBy(*by, *own, "i", "x").agg(F.sum("__s").alias("__s")).select(*by, "i", "x", (F.col("__s") / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))).alias("density"))
