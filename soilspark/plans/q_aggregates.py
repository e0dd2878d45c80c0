"""Aggregations by key and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.operators import aggregates, metrics
from soilspark.operators.quantiles import quantiles
from soilspark.operators.series import season
from soilspark.plans.catalog import Tables, query


@query("""SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderkey) FILTER (o_orderstatus <> 'P') AS status, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey""")
def group_first_nonnull(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_orderpriority")
    return aggregates.first_known(rows, ["o_custkey"], ["status", "o_orderpriority"], "o_orderkey")


@query("""SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS event_type, count(*) AS n FROM events GROUP BY user_id""")
def backfill_attributes(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"))
    return aggregates.first_known(rows, ["user_id"], ["event_type"], "event_id", empty=("",))


@query("SELECT l_suppkey, l_linenumber, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY ALL")
def group_mean_multi(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("""SELECT l_partkey, (CASE WHEN min(l_extendedprice / 100) <= 150 THEN 'YW' ELSE 'NW' END) || (CASE WHEN max(l_extendedprice / 7) >= 14000 THEN 'YD' ELSE 'ND' END) AS class FROM lineitem GROUP BY l_partkey""")
def coverage_class(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(aggregates.coverage_class(F.min(F.col("l_extendedprice") / 100), F.max(F.col("l_extendedprice") / 7)).alias("class"))


@query("""SELECT user_id, count(CASE WHEN event_type = 'click' THEN value END) AS click, count(CASE WHEN event_type = 'error' THEN value END) AS error, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def nonnull_counts(t: Tables) -> DataFrame:
    of = lambda k: F.count(F.when(F.col("event_type") == k, F.col("value"))).alias(k)
    return t.events.groupBy("user_id").agg(of("click"), of("error"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore_pop(t: Tables) -> DataFrame:
    return aggregates.standardised(t.events, "value", ["user_id"], "z").select("event_id", F.round("z", 6).alias("z"))


@query("SELECT l_linenumber, round(stddev_samp(l_discount), 6) AS s, round(avg(l_discount), 6) AS m, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_linenumber")
def extents_and_spread(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linenumber").agg(F.round(F.stddev_samp("l_discount"), 6).alias("s"), F.round(F.avg("l_discount"), 6).alias("m"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("""SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_linenumber""")
def quantiles_linear(t: Tables) -> DataFrame:
    return quantiles(t.lineitem, ["l_linenumber"], "l_extendedprice", [0.1, 0.5, 0.9]).select("l_linenumber", *[F.round(F.get("q", F.lit(k)), 4).alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


@query("""WITH m AS (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS r FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_type, p_size)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN m.p_size ELSE part.p_size END AS p_size FROM part JOIN m ON part.p_type = m.p_type AND r = 1""")
def mode_impute(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"))
    return rows.join(aggregates.mode_value(rows, ["p_type"], "p_size", "m"), "p_type").select("p_partkey", F.coalesce("p_size", "m").alias("p_size"))


@query("""SELECT o_orderpriority AS method, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) - count(*) FILTER (o_orderstatus = 'F') AS failed, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def method_summary(t: Tables) -> DataFrame:
    good = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"), good.alias("good"), (F.count("*") - good).alias("failed"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("total")


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT user_id, count(DISTINCT round_even(value, 0)) AS depths FROM events GROUP BY user_id")
def distinct_rounded(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_distinct(F.bround("value", 0)).alias("depths"))


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'error') AS b, avg(value) FILTER (event_type = 'view') AS c FROM events GROUP BY ALL)
SELECT user_id, date, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS m, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS k FROM p""")
def rowwise_mean_skipnull(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id", F.to_date("ts").alias("date")).pivot("event_type", ["click", "error", "view"]).agg(F.avg("value"))
    names = ["click", "error", "view"]
    return wide.select("user_id", "date", F.round(aggregates.row_mean([F.col(c) for c in names]), 6).alias("m"), aggregates.known_per_row(names).alias("k"))


@query("""SELECT CASE WHEN dayofyear(o_orderdate) >= 335 OR dayofyear(o_orderdate) <= 59 THEN 'winter' WHEN dayofyear(o_orderdate) <= 151 THEN 'spring' WHEN dayofyear(o_orderdate) <= 243 THEN 'summer' ELSE 'autumn' END AS season,
o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, max(o_totalprice) AS most FROM orders GROUP BY ALL""")
def seasonal_mean_std(t: Tables) -> DataFrame:
    return t.orders.groupBy(season(F.col("o_orderdate")).alias("season"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"), F.max("o_totalprice").alias("most"))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem)
SELECT x, y, round(r, 6) AS r FROM c, LATERAL (VALUES ('l_quantity', 'l_quantity', 1.0::DOUBLE), ('l_extendedprice', 'l_extendedprice', 1.0), ('l_discount', 'l_discount', 1.0), ('l_quantity', 'l_extendedprice', qe), ('l_extendedprice', 'l_quantity', qe), ('l_quantity', 'l_discount', qd), ('l_discount', 'l_quantity', qd), ('l_extendedprice', 'l_discount', ed), ('l_discount', 'l_extendedprice', ed)) AS v(x, y, r)""")
def corr_matrix(t: Tables) -> DataFrame:
    return metrics.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select("x", "y", F.round("r", 6).alias("r"))


@query("""SELECT l_returnflag, count(*) AS n, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg((p - y) ** 2), 6) AS mse, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) AS bias, round(avg(y), 6) AS mean_obs, round(stddev_samp(y), 6) AS std_obs
FROM (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem) GROUP BY l_returnflag""")
def regression_metrics(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_returnflag").agg(*metrics.regression_metrics(F.col("l_quantity"), F.col("l_extendedprice") / 1500))
    return m.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("l_returnflag", "n")])


@query("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def ols_line(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg(*metrics.line(F.col("l_extendedprice"), F.col("l_quantity")))
    return m.select("l_suppkey", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""SELECT label, CAST(p - 1 AS INTEGER) AS pos, round(sum(w * v) / sum(w), 6) AS value FROM (SELECT label, greatest(CAST(vec_id % 5 AS DOUBLE), 1e-6) AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p""")
def weighted_embedding_mean(t: Tables) -> DataFrame:
    return aggregates.weighted_mean_vector(t.embeddings, ["label"], "embedding", F.col("vec_id") % 5).select("label", "pos", F.round("value", 6).alias("value"))


@query("""SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id % 3, round_even(value, 1)) >= 30 AND value IS NOT NULL THEN NULL ELSE value END AS value FROM events""")
def repeated_fill_null(t: Tables) -> DataFrame:
    return aggregates.repeated_to_null(t.events.withColumn("g", F.col("user_id") % 3), "value", ["g"], digits=1).select("event_id", "value")


@query("""WITH s AS (SELECT o_orderstatus, epoch(d)::BIGINT - lag(epoch(d)::BIGINT) OVER (PARTITION BY o_orderstatus ORDER BY d) AS step FROM (SELECT DISTINCT o_orderstatus, o_orderdate AS d FROM orders)),
c AS (SELECT o_orderstatus, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY ALL) SELECT o_orderstatus, arg_min(step, (-n, step)) AS step FROM c GROUP BY 1""")
def modal_time_step(t: Tables) -> DataFrame:
    return aggregates.modal_step(t.orders, ["o_orderstatus"], "o_orderdate")


@query("""WITH h AS (SELECT least(CAST(floor((l_quantity - 0) / 5.0) AS INTEGER), 9) AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM h) * 5.0), 6) AS density FROM h GROUP BY bin""")
def histogram_bins(t: Tables) -> DataFrame:
    return aggregates.histogram(t.lineitem, "l_quantity", 0, 50, 10).select("bin", "n", F.round("density", 6).alias("density"))


@query("""SELECT l_partkey, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_discount, 0.025), 6) AS q025, round(quantile_cont(l_discount, 0.975), 6) AS q975 FROM lineitem GROUP BY l_partkey""")
def posterior_summary(t: Tables) -> DataFrame:
    q = F.percentile("l_discount", F.array(F.lit(0.025), F.lit(0.975)))
    return t.lineitem.groupBy("l_partkey").agg(F.avg("l_discount").alias("m"), q.alias("q")).select("l_partkey", F.round("m", 6).alias("mean"), F.round(F.get("q", F.lit(0)), 6).alias("q025"), F.round(F.get("q", F.lit(1)), 6).alias("q975"))


@query("""WITH f AS (SELECT l_suppkey, l_linenumber AS lag, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_max(lag, (r2, -lag)) AS best_lag, round(max(r2), 6) AS best_r2 FROM f WHERE r2 IS NOT NULL GROUP BY 1""")
def best_lag(t: Tables) -> DataFrame:
    f = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("lag")).agg(F.regr_r2("l_extendedprice", "l_quantity").alias("r2"))
    return metrics.best_lag(f, ["l_suppkey"]).withColumn("best_r2", F.round("best_r2", 6))


@query("""SELECT floor(c_acctbal / 1000)::BIGINT AS zone, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY 1""")
def zonal_mean(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.floor(F.col("c_acctbal") / 1000).alias("zone")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_linenumber, l_quantity::DOUBLE AS v FROM lineitem WHERE l_quantity IS NOT NULL), s AS (SELECT l_linenumber, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL),
g AS (SELECT l_linenumber, n, h, i, lo - 3 * h + i * ((hi - lo + 6 * h) / 49) AS x FROM s, (SELECT unnest(range(50)) AS i) WHERE h > 0)
SELECT g.l_linenumber, i::INTEGER AS i, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM g JOIN r USING (l_linenumber) GROUP BY g.l_linenumber, i, x""")
def kernel_densities(t: Tables) -> DataFrame:
    out = aggregates.kernel_density(t.lineitem, ["l_linenumber"], "l_quantity", points=50)
    return out.select("l_linenumber", "i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))
