"""Regression forests and linear models on assembled tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.operators import metrics
from soilspark.plans.assemble import missing_features


def imputed(df: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Null numbers become the mean, null categories the mode of the training rows (one small row of statistics)."""
    stats = train.agg(*[F.avg(c).alias(c) for c in numeric], *[F.mode(F.col(c), True).alias(c) for c in categorical]).first()
    return df.fillna({c: stats[c] for c in numeric + categorical if stats[c] is not None})


def scaled(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the training rows' mean and population deviation; a constant column becomes 0."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - float(stats[f"m_{c}"])) / float(stats[f"s_{c}"] or 1.0) for c in columns})


def trained(df: DataFrame, target: str, features: list[str], trees: int = 250, depth: int = 8, seed: int = 42, weight: str | None = None):
    """A fitted forest over the rows whose target and features are all known; fill what is missing before (``imputed``) for the others to train as well."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    more = {"weightCol": weight} if weight else {}
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol=f"{target}_pred", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512, **more)
    known = df.na.drop("any", subset=[target, *features])
    known = known.repartition(2 * known.sparkSession.sparkContext.defaultParallelism)  # the work on a row is far beyond reading it: all cores, however few files there are
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(known)


def inferred(model, df: DataFrame) -> DataFrame:
    """Predictions for every row, after the check that the table has every feature; null where a feature is unknown."""
    features, prediction = model.stages[0].getInputCols(), model.stages[-1].getPredictionCol()
    lacking = missing_features(features, df)
    if lacking:
        raise ValueError(f"the table lacks the features {', '.join(lacking)}")
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return model.transform(df).withColumn(prediction, F.when(known, F.col(prediction))).drop("features")


def trained_targets(df: DataFrame, targets: list[str], features: list[str], **more) -> dict:
    """A forest for each target."""
    return {y: trained(df, y, features, **more) for y in targets}


def inferred_targets(models: dict, df: DataFrame) -> DataFrame:
    """Every row with ``<target>_pred`` of each model."""
    for model in models.values():
        df = inferred(model, df)
    return df


def trained_levels(df: DataFrame, level: str, levels: list[int], targets: list[str], features: list[str], least: int = 10, **more) -> dict:
    """(level, target) -> forest, for the few depth levels that have ``least`` rows or more with this target."""
    known = df.where(F.col(level).isin(levels)).groupBy(level).agg(*[F.count(y).alias(y) for y in targets]).collect()
    able = [(r[level], y) for r in sorted(known, key=lambda r: r[level]) for y in targets if r[y] >= least]
    return {(k, y): trained(df.where(F.col(level) == k), y, features, **more) for k, y in able}


def inferred_levels(models: dict, df: DataFrame, level: str) -> DataFrame:
    """Every row with ``<target>_pred`` by the forest of its level; null where there is none."""
    out = df
    for (k, y), model in models.items():
        name = f"{y}_pred"
        out = inferred(model, out.withColumnRenamed(name, "__before")) if name in out.columns else inferred(model, out).withColumn("__before", F.lit(None).cast("double"))
        out = out.withColumn(name, F.when(F.col(level) == k, F.col(name)).otherwise(F.col("__before"))).drop("__before")
    return out


def saved(models: dict[str, object], path: str) -> None:
    """Forests by name in a new folder, with the list of their features as JSON lines."""
    from pyspark.sql import SparkSession

    for name, model in models.items():
        model.write().save(f"{path}/models/{name}")
    rows = [(name, list(model.stages[0].getInputCols()), model.stages[-1].getPredictionCol()) for name, model in models.items()]
    SparkSession.getActiveSession().createDataFrame(rows, "name string, features array<string>, prediction string").coalesce(1).write.json(f"{path}/features")


def loaded(spark, path: str) -> dict:
    """What ``saved`` wrote; a forest whose features are not those of the list is an error."""
    from pyspark.ml import PipelineModel

    out = {}
    for r in spark.read.schema("name string, features array<string>, prediction string").json(f"{path}/features").collect():
        out[r["name"]] = PipelineModel.load(f"{path}/models/{r['name']}")
        if list(out[r["name"]].stages[0].getInputCols()) != r["features"]:
            raise ValueError(f"{r['name']}: features differ from the list")
    return out


def importances(model, spark) -> DataFrame:
    """(feature, importance), largest first."""
    pairs = zip(model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray().tolist(), strict=True)
    return spark.createDataFrame(list(pairs), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def scored(df: DataFrame, targets: list[str]) -> DataFrame:
    """A row of metrics for each target with its prediction in ``<target>_pred``."""
    out = None
    for y in targets:
        one = df.agg(*metrics.regression_metrics(F.col(y), F.col(f"{y}_pred"))).select(F.lit(y).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def multi_regression_cv(rows: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """(by, r2_mean, rmse_mean, folds) of linear regressions on several features over rows with fold and role; of what can't be told apart the least.

    A regression and its errors on other rows follow from means and covariances, so these are aggregated by fold and role, partially first, and only they reach Python, many folds at once.
    A fold needs two rows to learn from and one to be judged by; r2 is null where the judged rows do not vary.
    """
    names = [*features, target]
    known = rows.select(*by, "fold", "role", *[F.col(c).cast("double").alias(c) for c in names]).na.drop("any", subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = [F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov")]
    parts = known.groupBy(*by, "fold", "role").agg(*moments)
    of = lambda role: F.max(F.when(F.col("role") == role, F.struct("n", "mean", "cov"))).alias(role)  # noqa: E731  there is one
    folds = parts.groupBy(*by, "fold").agg(of("train"), of("test")).select(*by, *[F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ("train", "test") for c in ("n", "mean", "cov")])
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    k = len(features)
    at = np.zeros((k + 1, k + 1), dtype=int)
    for i, (a, b) in enumerate(pairs):
        at[names.index(a), names.index(b)] = at[names.index(b), names.index(a)] = i

    def solved(batches):
        for batch in batches:
            out = batch[by].assign(r2=np.nan, rmse=np.nan)
            able = np.flatnonzero((batch["train_n"].fillna(0) >= 2) & (batch["test_n"].fillna(0) >= 1))
            if len(able):
                part = batch.iloc[able]
                (m, c), (u, d) = ((np.stack(part[f"{r}_mean"]), np.stack(part[f"{r}_cov"])[:, at]) for r in ("train", "test"))
                beta = (np.linalg.pinv(c[:, :k, :k], rcond=1e-10, hermitian=True) @ c[:, :k, k:])[..., 0]
                off = u[:, k] - m[:, k] - ((u[:, :k] - m[:, :k]) * beta).sum(axis=1)
                square = d[:, k, k] - 2 * (beta * d[:, :k, k]).sum(axis=1) + np.einsum("gi,gij,gj->g", beta, d[:, :k, :k], beta) + off**2
                spread = d[:, k, k]
                varied = spread > 1e-14 * np.maximum(u[:, k] ** 2, 1e-300)
                out.iloc[able, out.columns.get_loc("r2")] = np.where(varied, 1 - square / np.where(varied, spread, 1), np.nan)
                out.iloc[able, out.columns.get_loc("rmse")] = np.sqrt(np.maximum(square, 0))
            yield out

    told = folds.mapInPandas(solved, keys + ", r2 double, rmse double").withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("r2", "rmse")})
    return told.groupBy(*by).agg(F.avg("r2").alias("r2_mean"), F.avg("rmse").alias("rmse_mean"), F.count("rmse").cast("int").alias("folds"))
