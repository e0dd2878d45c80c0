"""Fits, forests and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import vg
from soilspark.operators import metrics, series, split
from soilspark.plans import assemble, battery, fit, forest
from soilspark.plans import posterior as posteriors
from soilspark.plans import vector_forest
from soilspark.plans.catalog import Tables, query
from soilspark.sources import scratch

# fixed values: suctions (cm) of a measured curve
SUCTIONS = [1.0, 10.0, 30.0, 60.0, 100.0, 330.0, 500.0, 1000.0, 3000.0, 5000.0, 10000.0, 15000.0]


def curves(t: Tables) -> DataFrame:
    """Twelve points of a curve with small deterministic deviations for each part."""
    p = t.part.select(
        "p_partkey", (0.03 + F.col("p_size") / 1000).alias("tr"), (0.4 + (F.col("p_partkey") % 7) / 100).alias("ts"), (0.005 + F.col("p_size") / 1000).alias("a"), (1.2 + (F.col("p_partkey") % 13) / 10).alias("n")
    )
    rows = p.withColumn("suction_cm", F.explode(F.array(*map(F.lit, SUCTIONS))))
    noise = (F.pmod(F.xxhash64("p_partkey", "suction_cm"), F.lit(1000)) - 500) / 500000
    return rows.select("p_partkey", F.lit(10.0).alias("depth_cm"), "suction_cm", (vg.theta(F.col("suction_cm"), *(F.col(c) for c in ("tr", "ts", "a", "n"))) + noise).alias("theta"))


@query()
def vg_fit_grouped(t: Tables) -> DataFrame:
    return fit.fits(curves(t), ["p_partkey", "depth_cm"])


@query()
def fit_method_compare(t: Tables) -> DataFrame:
    return fit.compared(fit.fits(curves(t), ["p_partkey", "depth_cm"], list(fit.METHODS)), ["p_partkey", "depth_cm"])


@query()
def inverse_fit(t: Tables) -> DataFrame:
    return fit.fits(curves(t), ["p_partkey", "depth_cm"], inverse=True)


@query()
def posterior_fit(t: Tables) -> DataFrame:
    return posteriors.posterior(curves(t), ["p_partkey", "depth_cm"])


@query()
def inverse_fit_weighted(t: Tables) -> DataFrame:
    return fit.fits(curves(t), ["p_partkey", "depth_cm"], inverse="weighted")


def _table(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", F.col("l_suppkey").alias("station"))
    return split.by_number(rows, F.col("station"), 0.3)


FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query()
def rf_train_metrics(t: Tables) -> DataFrame:
    rows = _table(t)
    model = vector_forest.grown(rows.where("role = 'train'"), ["l_extendedprice"], FEATURES)
    return forest.scored(vector_forest.inferred(model, rows.where("role = 'test'")), ["l_extendedprice"])


@query()
def rf_importance(t: Tables) -> DataFrame:
    model = vector_forest.grown(_table(t), ["l_extendedprice"], FEATURES)
    return vector_forest.importances(model, t.spark).where("target = 'all'").drop("target").orderBy(F.desc("importance"), "feature")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0.02 THEN l_tax END AS l_tax, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS l_returnflag,
CASE WHEN (l_suppkey * 2654435761) % 1000 < 300 THEN 'test' ELSE 'train' END AS role FROM lineitem),
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM r WHERE role = 'train'),
m AS (SELECT l_returnflag AS mode FROM r WHERE role = 'train' AND l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT l_orderkey, l_linenumber, role, round((l_quantity - mq) / sq, 6) AS l_quantity, round((coalesce(l_tax, mt) - mt) / st, 6) AS l_tax,
CAST(dense_rank() OVER (ORDER BY coalesce(l_returnflag, mode)) AS INTEGER) AS l_returnflag FROM r, s, m""")
def tabular_preparation(t: Tables) -> DataFrame:
    rows = _table(t).withColumn("l_tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax"))).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")))
    train = rows.where("role = 'train'")
    out = assemble.encoded(forest.scaled(forest.imputed(rows, train, ["l_tax"], ["l_returnflag"]), train, ["l_quantity", "l_tax"]), ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "role", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"), "l_returnflag")


def _site_days(t: Tables, how: str = "mean") -> DataFrame:
    days = series.daily(t.events, ["user_id"], "ts", "value", how=how)
    n = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("n"))
    return days.join(n, ["user_id", "date"], "left").where("value is not null").withColumn("doy", F.dayofyear("date").cast("double"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS y, count(*)::DOUBLE AS n FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL),
p AS (SELECT *, dayofyear(date)::DOUBLE AS doy, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS c FROM d), r AS (SELECT *, p < floor(c * 0.7) AS train FROM p),
m AS (SELECT user_id, count(*) AS k, avg(y) AS my, avg(n) AS mn, avg(doy) AS md, var_pop(n) * count(*) AS a, var_pop(doy) * count(*) AS b, covar_pop(n, doy) * count(*) AS g,
  covar_pop(n, y) * count(*) AS u, covar_pop(doy, y) * count(*) AS v FROM r WHERE train GROUP BY user_id),
f AS (SELECT *, a * b - g * g > 1e-9 * a * b AS whole FROM m WHERE k >= 2),
c AS (SELECT user_id, my, mn, md, CASE WHEN whole THEN (b * u - g * v) / (a * b - g * g) ELSE coalesce(u / nullif(a + b, 0), 0) END AS b1, CASE WHEN whole THEN (a * v - g * u) / (a * b - g * g) ELSE coalesce(v / nullif(a + b, 0), 0) END AS b2 FROM f),
e AS (SELECT r.user_id, y, y - my - b1 * (n - mn) - b2 * (doy - md) AS err FROM r JOIN c USING (user_id) WHERE NOT train),
s AS (SELECT user_id, 1 - sum(err * err) / nullif(var_pop(y) * count(*), 0) AS r2, sqrt(avg(err * err)) AS rmse FROM e GROUP BY user_id)
SELECT user_id, round(r2, 4) AS r2_mean, round(rmse, 4) AS rmse_mean, CASE WHEN rmse IS NULL THEN 0 ELSE 1 END AS folds FROM (SELECT DISTINCT user_id FROM d) LEFT JOIN s USING (user_id)""")
def cv_multi_feature(t: Tables) -> DataFrame:
    out = forest.multi_regression_cv(series.folds(_site_days(t), ["user_id"], "date"), ["user_id"], ["n", "doy"], "value")
    return out.select("user_id", F.round("r2_mean", 4).alias("r2_mean"), F.round("rmse_mean", 4).alias("rmse_mean"), "folds")


@query()
def site_battery(t: Tables) -> DataFrame:
    """Numbers of events a day explained by their mean value and two transforms of it, alone, with covariates, and lagged."""
    days = _site_days(t, "ordered").withColumns({"psi_cm_a": F.log10(1 + F.abs("value")), "psi_cm_b": F.sqrt(F.abs("value")), "dow": F.dayofweek("date").cast("double")})
    return battery.battery(days, ["user_id"], "date", ["n"], "value", ["psi_cm_a", "psi_cm_b"], ["doy", "dow"], below=0.6, least=1)


@query()
def posterior_fit_bounded(t: Tables) -> DataFrame:
    """Posteriors held to what a measured series of the same part shows."""
    days = curves(t).select("p_partkey", "depth_cm", "theta")
    return posteriors.posterior(curves(t), ["p_partkey", "depth_cm"], bounds=posteriors.series_bounds(days, ["p_partkey", "depth_cm"]))


def _levels(t: Tables) -> DataFrame:
    """Two targets by three levels, with null features and targets, and weights."""
    kinds = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    price, tax = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice") / 1000), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))
    weight = F.when(F.col("l_linenumber") == 1, 2.0).otherwise(1.0)
    return _table(t).withColumns({"level": kinds, "price": price, "l_tax": tax, "charge": F.col("l_quantity") * (1 - F.col("l_discount")), "weight": weight})


@query()
def forest_levels_metrics(t: Tables) -> DataFrame:
    """Forests of two targets for each level, weighted, judged on stations that they were not grown from."""
    rows = _levels(t)
    forests = vector_forest.grown_levels(rows.where("role = 'train'"), "level", ["price", "charge"], FEATURES, trees=100, weight="weight")
    got = vector_forest.inferred_levels(forests, rows.where("role = 'test'"), "level")
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).alias("y"), F.col(f"{y}_pred").alias("p")) for y in ("price", "charge")]))
    return got.select("level", each.alias("m")).select("level", "m.*").groupBy("level", "target").agg(*metrics.regression_metrics(F.col("y"), F.col("p")))


@query()
def forest_levels_importance(t: Tables) -> DataFrame:
    """What each feature says of each target, level by level."""
    out = None
    for level, model in vector_forest.grown_levels(_levels(t), "level", ["price", "charge"], FEATURES, trees=100).items():
        one = vector_forest.importances(model, t.spark).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def forest_read_back(t: Tables) -> DataFrame:
    """Predictions for every row by a forest that was written and read again; rows with an unknown feature have none."""
    rows = _levels(t)
    path = scratch.folder(t.spark, "forest")
    vector_forest.saved(vector_forest.grown(rows, ["price", "charge"], FEATURES, trees=50, depth=6), t.spark, path)
    got = vector_forest.inferred(vector_forest.loaded(t.spark, path), rows)
    return got.select("l_orderkey", "l_linenumber", F.round("price_pred", 6).alias("price_pred"), F.round("charge_pred", 6).alias("charge_pred"))
