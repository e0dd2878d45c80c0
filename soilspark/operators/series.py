"""Gap-aware daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, by: list[str], at: str, value: str, dense: bool = True, how: str = "mean") -> DataFrame:
    """(by, date, value): daily means or sums. Dense: every day between a series' first and last; a day without observations has a null mean, a zero sum.

    ``how``: mean, sum, or ordered, a mean whose values are added in the order of time, so that not even its last digit depends on where rows lie; what follows may ask whether two
    means are equal. That is a window over one series' day.
    """
    if how == "ordered":
        rows = df.select(*by, F.to_date(at).alias("date"), F.col(at).alias("__at"), F.col(value).cast("double").alias("__v"))
        upto = Window.partitionBy(*by, "date").orderBy("__at", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"__s": F.sum("__v").over(upto), "__k": F.count("*").over(upto)})
        days = rows.groupBy(*by, "date").agg(F.try_divide(F.max_by("__s", "__k"), F.count("__v")).alias(value))
    else:
        agg = F.avg(value) if how == "mean" else F.sum(value)
        days = df.groupBy(*by, F.to_date(at).alias("date")).agg(agg.alias(value))
    if not dense:
        return days
    ends = days.groupBy(*by).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    spine = ends.select(*by, F.explode(F.sequence("a", "z")).alias("date"))
    out = spine.join(days, [*by, "date"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(0.0))) if how == "sum" else out


def lags(df: DataFrame, by: list[str], order: str, columns: list[str], steps: list[int]) -> DataFrame:
    """Adds ``<column>_lag<k>``, the value ``k`` rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in steps})


def lag_correlations(df: DataFrame, by: list[str], order: str, target: str, other: str, steps: list[int]) -> DataFrame:
    """(by, lag, r): correlation of the target with the other series ``lag`` rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    shifted = df.select(*by, F.col(target).alias("y"), *[F.lag(other, k).over(w).alias(f"x{k}") for k in steps])
    both = lambda k: F.corr(F.when(F.col(f"x{k}").isNotNull(), F.col("y")), F.when(F.col("y").isNotNull(), F.col(f"x{k}")))
    wide = shifted.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias("lag"), both(k).alias("r")) for k in steps]).alias("m"))
    return wide.select(*by, F.inline("m"))


def drydown(df: DataFrame, by: list[str], order: str, theta: str, below: float = 0.4, least: int = 5) -> DataFrame:
    """Adds drydown: theta under its ``below`` quantile and falling over three rows (two at least, none unknown), in runs of ``least`` rows or more."""
    q = df.groupBy(*by).agg(F.percentile(theta, below).alias("__q"))
    w = Window.partitionBy(*by).orderBy(order)
    near = w.rowsBetween(-2, 0)
    rows = df.join(q, by).withColumn("__n", F.row_number().over(w))
    slope = F.when((F.count("*").over(near) >= 2) & (F.count("*").over(near) == F.count(theta).over(near)), F.regr_slope(F.col(theta), F.col("__n").cast("double")).over(near))
    rows = rows.withColumn("__m", F.coalesce((F.col(theta) < F.col("__q")) & (slope < 0), F.lit(False)))
    rows = rows.withColumn("__i", F.col("__n") - F.row_number().over(Window.partitionBy(*by, "__m").orderBy(order)))
    size = F.count("*").over(Window.partitionBy(*by, "__m", "__i"))
    return rows.withColumn("drydown", F.col("__m") & (size >= least)).drop("__q", "__n", "__m", "__i")


def runs(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """(by, start, stop, n): unbroken stretches of rows that hold."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__i", F.col("__n") - F.row_number().over(Window.partitionBy(*by, "__f").orderBy(order))).where("__f")
    return rows.groupBy(*by, "__i").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n")).drop("__i")


def scored_windows(df: DataFrame, by: list[str], order: str, columns: tuple[str, str], length: int, stride: int, shares: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(by, start, score): windows of ``length`` rows, every ``stride`` rows, scored by the absolute changes within. Windows with unknown values have none."""
    w = Window.partitionBy(*by).orderBy(order)
    inner = w.rowsBetween(1, length - 1)
    whole = w.rowsBetween(0, length - 1)
    rows = df.withColumn("start", F.row_number().over(w) - 1)
    for k, c in enumerate(columns):
        rows = rows.withColumn(f"__d{k}", F.abs(F.col(c) - F.lag(c).over(w)))
    known = sum((F.count(c).over(whole) for c in columns), F.lit(0))
    score = sum((s * F.sum(f"__d{k}").over(inner) for k, s in enumerate(shares)), F.lit(0.0))
    rows = rows.withColumn("score", score).withColumn("__k", known).withColumn("__c", F.count("*").over(whole))
    return rows.where((F.col("__c") == length) & (F.col("__k") == 2 * length) & (F.col("start") % stride == 0)).select(*by, "start", "score")


def top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefer_flagged(df: DataFrame, by: list[str], value: str, flag: str, good: str) -> DataFrame:
    """The mean of good observations, of all where none is good."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(flag) == good, F.col(value))), F.avg(value)).alias(value))


def season(date: Column) -> Column:
    """winter (day 335 to 59), spring, summer or autumn by day of the year."""
    d = F.dayofyear(date)
    return F.when((d >= 335) | (d <= 59), "winter").when(d <= 151, "spring").when(d <= 243, "summer").otherwise("autumn")


def folds(df: DataFrame, by: list[str], order: str, k: int = 5, least: int = 30) -> DataFrame:
    """(rows, fold, role): chronological folds. A series of up to 2 ``least`` rows, or k < 2, has one: 70 % train, the rest test. Others have the last k blocks of
    n // (k + 1) rows as tests, each after all rows before it; blocks of fewer than ``least`` rows are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__p", F.row_number().over(w) - 1)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = rows.join(sizes, by)
    n, p = F.col("__n"), F.col("__p")
    single = (n <= 2 * least) | F.lit(k < 2)
    cut = F.floor(n * 0.7)
    if k < 2:
        each = F.array(F.lit(1))
    else:
        each = F.when(single, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(k)))
    rows = rows.withColumn("fold", F.explode(each))
    block = F.floor(n / (k + 1))
    begin = n - (k + 1 - F.col("fold")) * block
    role = F.when(single, F.when(p < cut, "train").otherwise("test")).when(p < begin, "train").when(p < begin + block, "test")
    return rows.withColumn("role", role).where((F.col("role").isNotNull()) & (single | (block >= least))).drop("__p", "__n")


def cross_validated(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, r2_mean, rmse_mean, folds) of one-feature regressions fitted on train and scored on test rows of ``folds``."""
    fits = rows.where("role = 'train'").groupBy(*by, "fold").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(y).alias("__m"))
    test = rows.where("role = 'test'").join(fits, [*by, "fold"])
    err = F.col(y) - F.coalesce(F.col("a") + F.col("b") * F.col(x), F.col("__m"))
    scored = test.groupBy(*by, "fold").agg((1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"))
    return scored.groupBy(*by).agg(F.avg("r2").alias("r2_mean"), F.avg("rmse").alias("rmse_mean"), F.count("*").alias("folds"))
