"""Regressions of fluxes on soil water, site by site: what explains them best, and how late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilspark.operators import series
from soilspark.plans import forest

LAGS = (0, 3, 7, 14)


def battery(days: DataFrame, by: list[str], order: str, targets: list[str], theta: str, suctions: list[str], covariates: list[str], lags: tuple[int, ...] = LAGS, below: float = 0.4, least: int = 5) -> DataFrame:
    """(by, target, replicate, model, scope, lag, r2_mean, rmse_mean, folds) of chronologically cross-validated linear regressions.

    Each predictor, theta and the replicates of suction, explains each target alone (uni), with the covariates (mv), and with them as it was some rows before
    (lagged; of the ``lags`` the one of the best r2, the smallest if none is known). Scopes are all days, and the drydown days of theta. A regression takes the days
    of which all its values are known; one without such days has no row.
    """
    rows = series.lags(series.drydown(days, by, order, theta, below, least), by, order, [theta, *suctions], [k for k in lags if k])
    names = [f"x{k}" for k in range(len(covariates) + 1)]

    def regression(replicate: str, model: str, lag: int, x: str, others: list[Column]) -> Column:
        known = F.col(theta).isNotNull() if model == "uni" else F.lit(True)
        values = [F.when(known, F.col(x).cast("double")), *others]
        return F.struct(F.lit(replicate).alias("replicate"), F.lit(model).alias("model"), F.lit(lag).alias("lag"), *[v.alias(n) for n, v in zip(names, values, strict=True)])

    none, held = [F.lit(0.0)] * len(covariates), [F.col(c).cast("double") for c in covariates]
    each = []
    for x in [theta, *suctions]:
        each += [regression(x, "uni", 0, x, none), regression(x, "mv", 0, x, held)]
        each += [regression(x, "lagged", k, f"{x}_lag{k}" if k else x, held) for k in lags]
    scopes = F.when(F.col("drydown"), F.array(F.lit("all"), F.lit("drydown"))).otherwise(F.array(F.lit("all")))
    long = rows.select(*by, order, F.explode(scopes).alias("scope"), F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).cast("double").alias("y")) for y in targets]).alias("__t"), F.array(*each).alias("__r"))
    long = long.select(*by, order, "scope", F.explode("__t").alias("__t"), "__r").select(*by, order, "scope", "__t.*", F.explode("__r").alias("__r")).select(*by, order, "scope", "target", "y", "__r.*")
    long = long.na.drop("any", subset=["y", *names])
    keys = [*by, "target", "replicate", "model", "scope", "lag"]
    scored = forest.multi_regression_cv(series.folds(long, keys, order), keys, names, "y")
    best = Window.partitionBy(*by, "target", "replicate", "model", "scope").orderBy(F.col("r2_mean").desc_nulls_last(), "lag")
    return scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
