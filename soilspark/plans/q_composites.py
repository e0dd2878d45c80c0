"""Composites of scenes, grids and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.operators import composites as C
from soilspark.plans import features
from soilspark.plans.catalog import Tables, query

DOY = "dayofyear(o_orderdate)"
SHOWN = {"0": f"({DOY} >= 335 OR {DOY} <= 59)", "1": f"{DOY} BETWEEN 60 AND 151", "2": f"{DOY} BETWEEN 152 AND 243", "3": f"{DOY} BETWEEN 244 AND 334", "gs": f"{DOY} BETWEEN 121 AND 273"}


@query("SELECT o_custkey, " + ", ".join(f"round(coalesce({f}(o_totalprice) FILTER ({w}), -9999), 6) AS o_totalprice_{s}_{p}" for s, f in (("mean", "avg"), ("stdDev", "stddev_pop")) for p, w in SHOWN.items()) + " FROM orders GROUP BY o_custkey")
def period_composite(t: Tables) -> DataFrame:
    out = C.composite(t.orders, ["o_custkey"], ["o_totalprice"], "o_orderdate", fill=-9999.0)
    return out.select("o_custkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("SELECT label, CAST(p - 1 AS INTEGER) AS pos, round(avg(v), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p")
def embedding_yearly_mean(t: Tables) -> DataFrame:
    from soilspark.operators import aggregates

    return aggregates.weighted_mean_vector(t.embeddings, ["label"], "embedding", F.lit(1.0)).select("label", "pos", F.round("value", 6).alias("value"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_orderkey), 4) AS o_orderkey_mean FROM orders WHERE month(o_orderdate) >= 11 OR month(o_orderdate) <= 2 GROUP BY o_custkey")
def month_wrap_climatology(t: Tables) -> DataFrame:
    out = C.climatology(t.orders, ["o_custkey"], "o_orderdate", ["o_totalprice"], ["o_orderkey"], (11, 2))
    return out.select("o_custkey", F.round("o_totalprice_sum", 2).alias("o_totalprice_sum"), F.round("o_orderkey_mean", 4).alias("o_orderkey_mean"))


@query("SELECT o_custkey, round(avg(m), 4) AS mean, max(m) AS max, round(stddev_pop(m), 4) AS \"stdDev\" FROM (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_custkey")
def yearly_extremes(t: Tables) -> DataFrame:
    return C.yearly_extremes(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice").select("o_custkey", F.round("mean", 4).alias("mean"), "max", F.round("stdDev", 4).alias("stdDev"))


@query("SELECT o_custkey, count(DISTINCT greatest(least(year(o_orderdate), 2020), 1997)) AS n, count(DISTINCT greatest(least(year(o_orderdate), 2020), 1997)) >= 3 AS frequent FROM orders WHERE o_totalprice < 300000 GROUP BY o_custkey")
def history_mask(t: Tables) -> DataFrame:
    return C.frequent_years(t.orders.withColumn("year", F.year("o_orderdate")), ["o_custkey"], "year", F.col("o_totalprice") < 300000, least=3)


@query("SELECT l_suppkey, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS irr, round(avg(l_discount) FILTER (l_returnflag <> 'A'), 6) AS inv_irr, round(avg(l_discount), 6) AS no_mask FROM lineitem WHERE l_quantity <= 35 GROUP BY l_suppkey")
def masked_zonal_means(t: Tables) -> DataFrame:
    irr = F.col("l_returnflag") == "A"
    out = C.masked_means(t.lineitem.where("l_quantity <= 35"), ["l_suppkey"], "l_discount", {"irr": irr, "inv_irr": ~irr, "no_mask": F.lit(True)})
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("irr", "inv_irr", "no_mask")])


@query("""WITH m AS (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 4 END AS class FROM lineitem) SELECT l_suppkey, arg_min(class, (-n, class))::INT AS class FROM (SELECT l_suppkey, class, count(*) AS n FROM m GROUP BY ALL) GROUP BY l_suppkey""")
def class_remap_mode(t: Tables) -> DataFrame:
    from soilspark.operators import aggregates

    rows = t.lineitem.select("l_suppkey", C.remapped(F.col("l_linenumber"), {1: 0, 2: 1, 3: 1}, other=4).alias("class"))
    return aggregates.mode_value(rows, ["l_suppkey"], "class", "out").select("l_suppkey", F.col("out").alias("class"))


@query("""WITH g AS (SELECT (p_partkey // 20)::INT AS row, (p_partkey % 20)::INT AS col, p_retailprice AS v FROM part), n AS (SELECT a.row, a.col, a.v, avg(b.v) AS m FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)
SELECT row, col, CAST(floor(round(v - m + 0.5, 6)) AS BIGINT) AS tpi FROM n""")
def terrain_position(t: Tables) -> DataFrame:
    g = t.part.select(F.expr("cast(p_partkey div 20 as int)").alias("row"), (F.col("p_partkey") % 20).cast("int").alias("col"), "p_retailprice")
    mean = C.focal_difference(g, "row", "col", "p_retailprice", 1, offset=0.5 + 1e-9)
    return mean.select("row", "col", "tpi")


@query("""SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value) * 1000, 4) AS swe, round(min(value) - 273.15, 4) AS tmin, round(max(value) - 273.15, 4) AS tmax, round(sum(value) * 1000, 3) AS precip FROM events GROUP BY ALL""")
def hourly_to_daily(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.round(F.avg(v) * 1000, 4).alias("swe"), F.round(F.min(v) - 273.15, 4).alias("tmin"), F.round(F.max(v) - 273.15, 4).alias("tmax"), F.round(F.sum(v) * 1000, 3).alias("precip"))


@query("""SELECT c_custkey, variable, date, value FROM (SELECT c_custkey, 'swe' AS variable, DATE '2020-01-02' AS date, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'swe', DATE '2020-01-03', CASE WHEN c_acctbal > 0 THEN c_acctbal / 2 END FROM customer) WHERE value IS NOT NULL""")
def dated_columns_to_rows(t: Tables) -> DataFrame:
    wide = t.customer.select("c_custkey", F.col("c_acctbal").alias("swe_20200102"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 2).alias("swe_20200103"))
    return C.dated_columns(wide, ["c_custkey"])


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS shallow FROM events WHERE user_id % 2 = 0 OR event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS middle FROM events WHERE user_id % 2 = 0 OR event_type = 'view' GROUP BY ALL),
j AS (SELECT user_id, date, shallow, middle FROM a FULL JOIN b USING (user_id, date)) SELECT * FROM j WHERE user_id NOT IN (SELECT user_id FROM j WHERE shallow IS NULL OR middle IS NULL)""")
def complete_sites_only(t: Tables) -> DataFrame:
    e = t.events.withColumn("date", F.to_date("ts"))
    even = F.col("user_id") % 2 == 0
    a = e.where(even | (F.col("event_type") == "click")).groupBy("user_id", "date").agg(F.round(F.avg("value"), 6).alias("shallow"))
    b = e.where(even | (F.col("event_type") == "view")).groupBy("user_id", "date").agg(F.count("*").alias("middle"))
    return C.complete_sites([a, b], "user_id", "date")


@query("""SELECT s_suppkey, s_nationkey, round(0.0000275 * v - 0.2, 6) AS b5, round(0.00341802 * (v + 1) + 149, 6) AS b10 FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE s_acctbal * 2 END AS v FROM supplier)""")
def band_harmonise(t: Tables) -> DataFrame:
    a = F.col("s_acctbal")
    even = F.col("s_nationkey") % 2 == 0
    early = {f"B{k}": a if k == 4 else (a + 1 if k == 6 else F.lit(0.0)) for k in (1, 2, 3, 4, 5, 6, 7)}
    late = {f"B{k}": a * 2 if k == 5 else (a * 2 + 1 if k == 10 else F.lit(0.0)) for k in (2, 3, 4, 5, 6, 7, 10)}
    names = [f"B{k}" for k in (1, 2, 3, 4, 5, 6, 7, 10)]
    scenes = t.supplier.select("s_suppkey", "s_nationkey", F.when(even, "LANDSAT_5").otherwise("LANDSAT_8").alias("spacecraft_id"), *[F.when(even, early.get(b, F.lit(None))).otherwise(late.get(b, F.lit(None))).alias(b) for b in names])
    return C.harmonised(scenes).select("s_suppkey", "s_nationkey", F.round("B5", 6).alias("b5"), F.round("B10", 6).alias("b10"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NDVI ' || CASE WHEN p_partkey % 2 = 0 THEN 'mean' ELSE 'std dev' END || ' (Q' || (p_partkey % 4 + 1) || ')'
WHEN 1 THEN 'SoilGrids bulk density std dev (' || p_size || '-200cm)' ELSE 'Site embedding ' || p_size END AS label FROM part""")
def feature_labels(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    index = F.concat(F.lit("nd_"), F.when(k % 2 == 0, "mean").otherwise("stdDev"), F.lit("_"), (k % 4 + 1).cast("string"))
    name = F.when(k % 3 == 0, index).when(k % 3 == 1, F.concat(F.lit("bdod_"), size, F.lit("-200cm_stdDev"))).otherwise(F.concat(F.lit("e"), F.lpad(size, 3, "0")))
    return t.part.select("p_partkey", features.label(name).alias("label"))


@query("""SELECT p_partkey, DATE '1900-01-01' + p_size AS date, round(v, 4) AS value FROM (SELECT p_partkey, p_size, arg_min(c_acctbal, c_custkey) AS v FROM (SELECT p_partkey, p_size, round_even(p_size / 10.0, 0) AS i FROM part) JOIN (SELECT c_custkey, c_acctbal, round_even(c_nationkey / 10.0, 0) AS i FROM customer) USING (i) GROUP BY ALL)""")
def nearest_cell_series(t: Tables) -> DataFrame:
    cells = t.customer.select(F.col("c_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), "c_custkey", "c_acctbal")
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("px"), F.lit(0.0).alias("py"), C.decoded_days(F.col("p_size"), "1900-01-01").alias("date"))
    out = C.cell_series(cells, points, "px", "py", 10.0, ["p_partkey"], ["c_custkey"])
    return out.select("p_partkey", "date", F.round("c_acctbal", 4).alias("value"))


_DRAW = "CAST('0x' || substr(md5(vec_id || ':42:' || {}), 1, 12) AS BIGINT) % 1000000"


@query(f"""WITH p AS (SELECT vec_id, {_DRAW.format("'k'")} % 3 AS kind, {_DRAW.format("'p'")} * 49 // 1000000 AS begin FROM embeddings),
m AS (SELECT vec_id, kind, i, CASE kind WHEN 0 THEN {_DRAW.format("i")} < 250000 WHEN 1 THEN i >= begin AND i < begin + 16 ELSE i >= 48 END AS hidden FROM p, (SELECT unnest(range(64)) AS i))
SELECT m.vec_id, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE, 6) AS value FROM m JOIN embeddings USING (vec_id) WHERE hidden""")
def mask_patches(t: Tables) -> DataFrame:
    """The places and values that masks of all three kinds hide of each vector's first 64."""
    m = C.masked_positions(64, 0.25, "mixed", F.col("vec_id"))
    rows = t.embeddings.select("vec_id", F.posexplode(m).alias("i", "hidden"), "embedding").where("hidden")
    return rows.select("vec_id", "i", F.round(F.get("embedding", F.col("i")).cast("double"), 6).alias("value"))


@query("""SELECT l_suppkey, round(avg(vv), 6) AS "VV_mean", round(stddev_pop(vv), 6) AS "VV_stdDev", round(avg(vh), 6) AS "VH_mean", round(stddev_pop(vh), 6) AS "VH_stdDev", round(avg(vh / vv), 6) AS "VH_VV_mean", round(stddev_pop(vh / vv), 6) AS "VH_VV_stdDev"
FROM (SELECT *, l_discount + 1 AS vv, l_tax + 1 AS vh FROM lineitem) WHERE l_linenumber % 3 <> 0 AND l_returnflag <> 'R' AND year(l_shipdate) BETWEEN 1993 AND 2010 GROUP BY l_suppkey""")
def radar_means(t: Tables) -> DataFrame:
    both = F.when(F.col("l_linenumber") % 3 != 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))
    scenes = t.lineitem.select("l_suppkey", "l_shipdate", both.alias("polarisations"), F.when(F.col("l_returnflag") == "R", "EW").otherwise("IW").alias("mode"), (F.col("l_discount") + 1).alias("VV"), (F.col("l_tax") + 1).alias("VH"))
    out = C.radar_climatology(scenes, ["l_suppkey"], "l_shipdate", (1993, 2010))
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("""WITH g AS (SELECT (p_partkey // 20)::INT AS row, (p_partkey % 20)::INT AS col, p_retailprice AS v FROM part), d AS (SELECT g.row, g.col, (e.v - w.v) / 60 AS dx, (n.v - s.v) / 60 AS dy FROM g
LEFT JOIN g e ON e.row = g.row AND e.col = g.col + 1 LEFT JOIN g w ON w.row = g.row AND w.col = g.col - 1 LEFT JOIN g n ON n.col = g.col AND n.row = g.row - 1 LEFT JOIN g s ON s.col = g.col AND s.row = g.row + 1)
SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, CASE WHEN dx * dx + dy * dy > 0 THEN round((degrees(atan2(-dx, -dy)) + 360) % 360, 5) END AS aspect FROM d""")
def terrain_slope(t: Tables) -> DataFrame:
    g = t.part.select(F.expr("cast(p_partkey div 20 as int)").alias("row"), (F.col("p_partkey") % 20).cast("int").alias("col"), "p_retailprice")
    return C.slope_aspect(g, "row", "col", "p_retailprice", 30.0).select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"))


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 24 END AS class FROM orders), own AS (SELECT o_custkey, min(class) AS class FROM o WHERE y = 1995 GROUP BY o_custkey),
c AS (SELECT o_custkey, class, count(*) AS n FROM o WHERE y BETWEEN 1992 AND 2024 GROUP BY ALL), usual AS (SELECT o_custkey, arg_min(class, (-n, class)) AS class FROM c GROUP BY o_custkey)
SELECT o_custkey, coalesce(own.class, usual.class)::INT AS class FROM own FULL JOIN usual USING (o_custkey)""")
def crop_of_year(t: Tables) -> DataFrame:
    crop = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 5).otherwise(24)
    layers = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"), crop.alias("class"))
    return C.class_of_year(layers, ["o_custkey"], "year", "class", 1995, (1992, 2024))


@query("""WITH p AS (SELECT user_id, 's' || strftime(ts, '%Y%m%d') AS scene, year(ts) AS year, value AS b2, value * 2 + 1 AS b3 FROM events WHERE event_type <> 'click'), m AS (SELECT user_id, scene, year, avg(b2) AS b2, avg(b3) AS b3 FROM p GROUP BY ALL)
SELECT user_id, year::INT AS year, scene || '_B2' AS name, round(b2, 6) AS value FROM m WHERE b2 IS NOT NULL UNION ALL SELECT user_id, year::INT, scene || '_B3', round(b3, 6) FROM m WHERE b3 IS NOT NULL""")
def scene_band_means(t: Tables) -> DataFrame:
    pixels = t.events.select("user_id", "ts", F.concat(F.lit("s"), F.date_format("ts", "yyyyMMdd")).alias("scene"), F.col("value").alias("B2"), (F.col("value") * 2 + 1).alias("B3"), "event_type")
    return C.scene_means(pixels, "user_id", "scene", "ts", ["B2", "B3"], F.col("event_type") != "click").withColumn("value", F.round("value", 6))


@query("""WITH k AS (SELECT DISTINCT l_suppkey, 'LC08_' || strftime(l_shipdate, '%Y%m%d') || '_' || l_linenumber AS scene FROM lineitem WHERE l_quantity <= 35)
SELECT l_suppkey, scene, row_number() OVER (PARTITION BY l_suppkey ORDER BY regexp_extract(scene, '([0-9]{8})', 1), scene)::INT AS n FROM k""")
def scenes_of_little_cloud(t: Tables) -> DataFrame:
    scenes = t.lineitem.select("l_suppkey", "l_quantity", F.concat(F.lit("LC08_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_"), "l_linenumber").alias("scene"))
    return C.ordered_scenes(scenes, "l_suppkey", "scene", "l_quantity", 35)


@query("SELECT o_custkey, " + ", ".join(f"round({f}({c}) FILTER ({w}), 6) AS {c}_{s}_{p}" for c, each in (("o_totalprice", (("mean", "avg"), ("max", "max"))), ("o_orderkey", (("max", "max"),))) for s, f in each for p, w in SHOWN.items()) + " FROM orders GROUP BY o_custkey")
def seasonal_extremes(t: Tables) -> DataFrame:
    out = C.period_statistics(t.orders.withColumn("o_orderkey", F.col("o_orderkey").cast("double")), ["o_custkey"], "o_orderdate", {"o_totalprice": ("mean", "max"), "o_orderkey": ("max",)})
    return out.select("o_custkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("SELECT l_suppkey, " + ", ".join(f"round(avg({c}) FILTER (l_linenumber = {k}), 6) AS polaris_{v}_{a}_{z}cm" for v, c in (("clay", "l_discount"), ("n", "l_tax")) for k, (a, z) in enumerate(((0, 5), (5, 15), (15, 30)), 1)) + " FROM lineitem GROUP BY l_suppkey")
def property_columns(t: Tables) -> DataFrame:
    from soilspark.operators import reshape

    depths = [(0, 5), (5, 15), (15, 30)]
    level = lambda i: F.coalesce(F.get(F.array(*[F.lit(d[i]) for d in depths]), F.col("l_linenumber") - 1), F.lit(999))
    each = F.explode(F.array(F.struct(F.lit("clay").alias("variable"), F.col("l_discount").alias("value")), F.struct(F.lit("n").alias("variable"), F.col("l_tax").alias("value"))))
    rows = t.lineitem.select("l_suppkey", level(0).alias("top"), level(1).alias("bottom"), each.alias("e")).select("l_suppkey", "top", "bottom", "e.*")
    out = reshape.property_stack(rows, ["l_suppkey"], "variable", "top", "bottom", "value", ["clay", "n"], depths)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
