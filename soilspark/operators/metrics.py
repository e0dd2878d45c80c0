"""Agreement of predictions with observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(y: Column, p: Column) -> list[Column]:
    """n, r2, mse, rmse, mae, bias and the observations' mean and sample deviation, over pairs without null. r2 is null where observations don't vary."""
    ok = y.isNotNull() & p.isNotNull()
    obs, err = F.when(ok, y), F.when(ok, p - y)
    total = F.var_pop(obs) * F.count(obs)
    mse = F.avg(err * err)
    return [
        F.count(obs).alias("n"), (1 - F.try_divide(F.sum(err * err), total)).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"), F.avg(obs).alias("mean_obs"), F.stddev_samp(obs).alias("std_obs"),
    ]


def line(y: Column, x: Column) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(x, y, r) of each two columns, over the rows where both are known, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    wide = df.groupBy(*(by or [])).agg(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), both(a, b).alias("r")) for a, b in pairs]).alias("m"))
    return wide.select(*(by or []), F.inline("m"))


def best_lag(df: DataFrame, by: list[str], lag: str = "lag", score: str = "r2") -> DataFrame:
    """The lag of the best known score, the smaller of two."""
    return df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(lag, F.struct(F.col(score), -F.col(lag))).alias("best_lag"), F.max(score).alias(f"best_{score}"))
