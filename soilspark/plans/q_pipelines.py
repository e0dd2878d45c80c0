"""Pipelines of several operators on the tables' roles: orders are dated fits, customers sites, lineitems observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import vg
from soilspark.operators import joins, metrics
from soilspark.plans import assemble, compare, standardize
from soilspark.plans.catalog import Tables, query
from soilspark.plans.q_scalars import FORWARD, PARAMS, params


@query("""WITH a AS (SELECT 'ncss_' || l_partkey || '_' || l_linenumber AS sample_id, 'ncss' AS source, CAST(l_linenumber AS DOUBLE) AS depth_cm, count(*)::INT AS data_ct, avg(l_discount) AS theta_r, avg(0.4 + l_tax) AS theta_s, avg(0.01 + l_tax) AS alpha, avg(1.1 + l_discount) AS n, CAST(l_partkey AS VARCHAR) AS k FROM lineitem GROUP BY l_partkey, l_linenumber),
b AS (SELECT 'rosetta_' || p_partkey, 'rosetta', NULL, -9999, 0.05, 0.45, round(pow(10, -2.0), 6), 1.5, CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25)
SELECT sample_id, source, depth_cm, data_ct, round(theta_r, 6) AS theta_r, round(theta_s, 6) AS theta_s, round(alpha, 6) AS alpha, round(n, 6) AS n, p_brand, p_retailprice FROM (SELECT * FROM a WHERE data_ct >= 3 UNION ALL SELECT * FROM b) u LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = u.k""")
def unified_table(t: Tables) -> DataFrame:
    fits = t.lineitem.groupBy(F.col("l_partkey").alias("profile_id"), F.col("l_linenumber").alias("depth_cm")).agg(
        F.count("*").cast("int").alias("data_ct"), F.avg("l_discount").alias("theta_r"), F.avg(0.4 + F.col("l_tax")).alias("theta_s"), F.avg(0.01 + F.col("l_tax")).alias("alpha"), F.avg(1.1 + F.col("l_discount")).alias("n")
    )
    rosetta = t.part.where("p_size > 25").select(F.col("p_partkey").alias("site_id"), F.lit(0.05).alias("theta_r"), F.lit(0.45).alias("theta_s"), F.lit(-2.0).alias("log10_alpha"), F.log10(F.lit(1.5)).alias("log10_n"))
    features = t.part.select(F.col("p_partkey").cast("string").alias("id"), "p_brand", "p_retailprice")
    out = assemble.unified([(assemble.source("ncss"), fits), (assemble.source("rosetta"), rosetta)], features, "id", ["p_brand"], least=3)
    return out.select("sample_id", "source", F.col("depth_cm").cast("double").alias("depth_cm"), "data_ct", *[F.round(c, 6).alias(c) for c in vg.PARAMS], "p_brand", "p_retailprice")


COMPARED = """SELECT l_linenumber AS level, avg(l_discount) AS fit, avg(l_tax) AS other, l_partkey FROM lineitem GROUP BY l_partkey, l_linenumber"""


@query(f"""WITH c AS ({COMPARED}), r AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'Validation' ELSE 'Train' END AS role FROM c)
SELECT role, level, count(*) AS n, round(1 - sum((other - fit) ** 2) / nullif(var_pop(fit) * count(*), 0), 6) AS r2, round(sqrt(avg((other - fit) ** 2)), 6) AS rmse, round(avg(other - fit), 6) AS bias FROM r GROUP BY role, level""")
def comparison_table(t: Tables) -> DataFrame:
    by = ["l_partkey", "l_linenumber"]
    a = t.lineitem.groupBy(*by).agg(F.avg("l_discount").alias("theta_r"))
    b = t.lineitem.groupBy(*by).agg(F.avg("l_tax").alias("theta_r"))
    both = compare.side_by_side({"fit": a, "other": b}, by, ["theta_r"])
    both = both.withColumn("role", F.when(F.col("l_partkey") % 5 == 0, "Validation").otherwise("Train")).withColumnRenamed("l_linenumber", "level")
    out = compare.agreement(both, "fit", ["other"], ["theta_r"], ["role", "level"])
    return out.select("role", "level", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "bias")])


@query("""WITH b AS (SELECT l_partkey AS k, l_linenumber AS level, avg(l_discount) AS tr, avg(l_quantity) / 100 AS ts, avg(l_tax) AS a, avg(l_extendedprice) / 1000 AS n FROM lineitem GROUP BY ALL),
o AS (SELECT *, 'rosetta' AS other, 0.01 * (k % 3) AS d FROM b UNION ALL SELECT *, 'pretrain', CASE WHEN level % 2 = 0 THEN 0.02 * (k % 5) END FROM b UNION ALL SELECT *, 'finetune', CASE WHEN k % 4 = 0 THEN -0.01 * (k % 2 + 1) END FROM b),
l AS (SELECT level, other, p, y + d AS v, CASE WHEN d IS NOT NULL THEN y END AS y FROM o, LATERAL (VALUES ('theta_r', tr), ('theta_s', ts), ('alpha', a), ('n', n)) AS x(p, y))
SELECT level, p AS param, other, count(y) AS n, round(1 - sum((v - y) ** 2) / nullif(var_pop(y) * count(y), 0), 6) AS r2, round(sqrt(avg((v - y) ** 2)), 6) AS rmse, round(avg(v - y), 6) AS bias FROM l GROUP BY ALL""")
def sources_compared(t: Tables) -> DataFrame:
    """All four parameters of three sources, each of other coverage, against the fitted ones by level."""
    by, k = ["l_partkey", "level"], F.col("l_partkey")
    fitted = t.lineitem.withColumnRenamed("l_linenumber", "level").groupBy(*by).agg(F.avg("l_discount").alias("theta_r"), (F.avg("l_quantity") / 100).alias("theta_s"), F.avg("l_tax").alias("alpha"), (F.avg("l_extendedprice") / 1000).alias("n"))
    moved = lambda df, d: df.withColumns({p: F.col(p) + d for p in vg.PARAMS})
    sources = {"station": fitted, "rosetta": moved(fitted, 0.01 * (k % 3)), "pretrain": moved(fitted.where("level % 2 = 0"), 0.02 * (k % 5)), "finetune": moved(fitted.where(k % 4 == 0), -0.01 * (k % 2 + 1))}
    out = compare.agreement(compare.side_by_side(sources, by, list(vg.PARAMS)), "station", ["rosetta", "pretrain", "finetune"], list(vg.PARAMS), ["level"])
    return out.select("level", "param", "other", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "bias")])


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(o_totalprice) AS known FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 5 THEN 'skipped' ELSE 'built' END AS status,
CASE WHEN n IS NULL THEN 'no observations' WHEN n < 5 THEN 'fewer than 5 observations' END AS reason FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def site_ledger(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return compare.ledger(t.customer.select("c_custkey"), rows, "c_custkey", 5)


@query("""WITH q AS (SELECT avg(tr) AS tr, avg(ts) AS ts, avg(n) AS n, avg(a) AS mean, quantile_cont(a, 0.1) AS p10, quantile_cont(a, 0.5) AS p50, quantile_cont(a, 0.9) AS p90 FROM (""" + PARAMS + """)),
g AS (SELECT pow(10, i * 5 / 99.0) AS psi, i FROM range(0, 100) AS r(i)), v AS (SELECT tr, ts, n, stat, a FROM q, LATERAL (VALUES ('mean', mean), ('p10', p10), ('p50', p50), ('p90', p90)) AS s(stat, a))
SELECT stat, i::INT AS i, round(""" + FORWARD + ", 6) AS theta FROM v, g")
def influence_curves(t: Tables) -> DataFrame:
    return compare.influence(params(t).withColumnsRenamed({"tr": "theta_r", "ts": "theta_s", "a": "alpha"}), "alpha").select("stat", "i", F.round("theta", 6).alias("theta"))


@query("""SELECT profile_id, depth_cm, suction_cm, theta FROM (SELECT CAST(l_partkey AS VARCHAR) AS profile_id, CAST(l_linenumber * 5 AS DOUBLE) AS depth_cm, round(abs(l_extendedprice) * 10.19716, 4) AS suction_cm, round(l_quantity / 100, 6) AS theta, count(*) OVER (PARTITION BY l_partkey, l_linenumber) AS c FROM lineitem WHERE l_returnflag <> 'N') WHERE c >= 4""")
def standardised_network(t: Tables) -> DataFrame:
    raw = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_partkey").alias("Sample_ID"), (F.col("l_linenumber") * 5.0).alias("Depth_cm"), (-F.col("l_extendedprice")).alias("KPA"), F.col("l_quantity").alias("VWC"))
    out = standardize.network(raw, key="Sample_ID", depth="Depth_cm", suction="KPA", unit="kPa", water="VWC", percent=True, least=4)
    return out.select("profile_id", "depth_cm", F.round("suction_cm", 4).alias("suction_cm"), F.round("theta", 6).alias("theta"))


@query("""WITH m AS (SELECT l_partkey, CAST(replace(variable, 'w', '') AS DOUBLE) AS suction_cm, value / 100 * 1.3 AS theta FROM (SELECT l_partkey, avg(l_quantity) AS w60, avg(l_discount) * 100 AS w340, avg(l_tax) * 100 AS w15296 FROM lineitem GROUP BY 1) UNPIVOT (value FOR variable IN (w60, w340, w15296)))
SELECT CAST(l_partkey AS VARCHAR) AS profile_id, suction_cm, round(theta, 6) AS theta, (CASE WHEN min(suction_cm) OVER w <= 150 THEN 'YW' ELSE 'NW' END) || (CASE WHEN max(suction_cm) OVER w >= 14000 THEN 'YD' ELSE 'ND' END) AS class FROM m WINDOW w AS (PARTITION BY l_partkey)""")
def long_form_with_class(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("profile_id")).agg(F.avg("l_quantity").alias("w60"), (F.avg("l_discount") * 100).alias("w340"), (F.avg("l_tax") * 100).alias("w15296"))
    out = standardize.gravimetric_long(wide.withColumn("density", F.lit(1.3)), ["profile_id"], {"w60": 60.0, "w340": 340.0, "w15296": 15296.0}, "density")
    return out.select("profile_id", "suction_cm", F.round("theta", 6).alias("theta"), "class")


@query("""SELECT l_suppkey, round(avg(abs(l_quantity - l_extendedprice / 1500) / l_quantity) * 100, 4) AS relative_error FROM lineitem GROUP BY 1""")
def relative_error(t: Tables) -> DataFrame:
    err = F.abs(F.col("l_quantity") - F.col("l_extendedprice") / 1500) / F.col("l_quantity") * 100
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(err), 4).alias("relative_error"))


@query("""WITH x AS (SELECT l_linenumber AS level, l_discount AS v, 'fit' AS source FROM lineitem UNION ALL SELECT l_linenumber, l_tax, 'map' FROM lineitem) SELECT source, level, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM x GROUP BY ALL""")
def distribution_table(t: Tables) -> DataFrame:
    one = lambda c: t.lineitem.select(F.col("l_linenumber").alias("level"), F.col(c).alias("v"))
    out = compare.distributions({"fit": one("l_discount"), "map": one("l_tax")}, ["level"], "v")
    return out.select("source", "level", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("""SELECT label, round(least(max(x), avg(x) + 2 * stddev_pop(x)), 6) AS top FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label""")
def colour_scale(t: Tables) -> DataFrame:
    x = F.get("embedding", F.lit(0)).cast("double")
    return t.embeddings.groupBy("label").agg(F.round(F.least(F.max(x), F.avg(x) + 2 * F.stddev_pop(x)), 6).alias("top"))


@query("""SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, min(CAST(ts AS DATE)) AS start, max(CAST(ts AS DATE)) AS stop, count(value) AS n FROM events GROUP BY user_id""")
def observation_summary(t: Tables) -> DataFrame:
    d = F.to_date("ts")
    return t.events.groupBy("user_id").agg(F.count_distinct(d).alias("days"), F.min(d).alias("start"), F.max(d).alias("stop"), F.count("value").alias("n"))


@query("""SELECT o_orderpriority AS model, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) = 1 THEN o_orderpriority ELSE '' END AS shown, o_orderstatus AS param, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def presentation_table(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("param")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    return compare.blank_repeats(rows, "model", "param", "shown")


@query("""WITH m AS (SELECT l_partkey, l_linenumber, avg(l_discount) AS y FROM lineitem GROUP BY ALL), c AS (SELECT l_partkey, arg_min(l_linenumber, (abs(l_linenumber * 10 - 33), l_linenumber)) AS l FROM m GROUP BY 1)
SELECT l_partkey, l_linenumber, round(y, 6) AS y FROM m JOIN c USING (l_partkey) WHERE l_linenumber = l""")
def nearest_depth_per_site(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_partkey", "l_linenumber").agg(F.avg("l_discount").alias("y"))
    out = m.groupBy("l_partkey").agg(F.min_by(F.struct("l_linenumber", "y"), F.struct(F.abs(F.col("l_linenumber") * 10 - 33), "l_linenumber")).alias("r"))
    return out.select("l_partkey", "r.l_linenumber", F.round("r.y", 6).alias("y"))


@query("""SELECT user_id, round(sum(value * 1800 / 2.45e6), 8) AS et, round(avg(value), 6) AS theta, count(*) AS n FROM events WHERE value > 0 GROUP BY user_id""")
def site_flux_daily(t: Tables) -> DataFrame:
    from soilspark.functions import clean

    rows = clean.missing_to_null(t.events, ["value"], at_most=0.0)
    return rows.where("value is not null").groupBy("user_id").agg(F.round(F.sum(clean.et_from_latent_heat(F.col("value"), F.lit(1800))), 8).alias("et"), F.round(F.avg("value"), 6).alias("theta"), F.count("*").alias("n"))


@query("""SELECT p_brand, p_type, p_retailprice FROM (SELECT p_brand, arg_min(p_type, p_partkey) FILTER (p_type <> 'ECONOMY') AS p_type, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY p_brand)""")
def feature_table(t: Tables) -> DataFrame:
    half = lambda r: t.part.where(F.col("p_partkey") % 2 == r)
    known = F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("p_type")
    frames = [half(0).select("p_brand", "p_partkey", known, "p_retailprice"), half(1).select("p_brand", "p_partkey", known, "p_retailprice", "p_name")]
    return assemble.feature_table(frames, "p_brand", ["p_name"], [], order="p_partkey").select("p_brand", "p_type", "p_retailprice")
