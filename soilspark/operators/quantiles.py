"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilspark.sources.scratch import kept

BINS = 16_384
FEW = 5_000  # groups whose intervals the driver holds between rounds
MAX_BROADCAST = 200_000  # intervals looked for at once, some 100 bytes each


def _met(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{c}"]) for c in names], F.lit(True))


def _other(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in names})


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """(by, n, q): of the known values of each group the number and the linear quantiles at ``probs``; a group without known values has no row.

    Order statistics are found by rounds of refinement: the interval that holds a rank is cut into ``bins`` of equal width, a partial aggregation counts them with their smallest and largest values, and the
    bin of the rank is the next interval, until its values are all equal. A round takes the smallest and largest values apart at least and mostly leaves a few thousandth, so two to four
    passes over the rows are usual. Between rounds the driver holds the intervals of at most ``FEW`` groups, those of more are written; no task holds a group's values.
    """
    known = F.col(value).cast("double")
    rows = df.select(*by, known.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    some = ends.limit(FEW + 1).collect()
    few = len(some) <= FEW
    spark = df.sparkSession
    ends = spark.createDataFrame(some, ends.schema) if few else kept(ends, "extents")
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    state = ends.select(*by, F.explode(wanted).alias("rank"), F.lit(0).cast("long").alias("before"), "lo", "hi")
    where = [*by, "lo", "hi"]
    while True:
        held = state.collect() if few else None
        state = spark.createDataFrame(held, state.schema) if few else kept(state, "ranks")
        done, open_ = state.where("lo = hi"), state.where("lo < hi")
        spans = open_.select(*where).distinct()
        n = sum(r["lo"] < r["hi"] for r in held) if few else spans.count()
        if not n:
            break
        s = _other(spans, where)
        s = F.broadcast(s) if n <= MAX_BROADCAST else s
        inside = rows.join(s, _met(rows, s, by) & F.col("__v").between(F.col("__lo"), F.col("__hi")))
        scale = F.when(F.greatest(F.abs("__lo"), F.abs("__hi")) > 8e307, 0.5).otherwise(1.0)  # else the width may be beyond the largest number
        at = F.least(F.floor((F.col("__v") * scale - F.col("__lo") * scale) / (F.col("__hi") * scale - F.col("__lo") * scale) * bins), F.lit(bins - 1))
        binned = inside.select(*by, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), at.alias("bin"), "__v")
        counted = binned.groupBy(*where, "bin").agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        upto = Window.partitionBy(*where).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = _other(counted.withColumn("past", F.sum("c").over(upto)), [*where, "c", "past", "least", "most"])
        begin = F.col("before") + F.col("__past") - F.col("__c")
        hit = open_.join(h, _met(open_, h, where) & (F.col("rank") >= begin) & (F.col("rank") < F.col("before") + F.col("__past")))
        state = done.unionByName(hit.select(*by, "rank", begin.alias("before"), F.col("__least").alias("lo"), F.col("__most").alias("hi")))
    found = _other(done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("m")), by)
    both = ends.join(found, _met(ends, found, by))

    def linear(x: Column) -> Column:
        low, high = (F.element_at("m", f(x).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    return both.select(*by, "n", F.array(*[linear(x) for x in place]).alias("q"))
