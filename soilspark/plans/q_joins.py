"""Scans, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import clean, depth
from soilspark.operators import joins, reshape
from soilspark.plans.catalog import Tables, query


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 25")
def scan_project_filter(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 25)).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT event_id, value FROM events WHERE lower(event_type) LIKE '%c%' AND event_type NOT LIKE '%error%'")
def contains_filter(t: Tables) -> DataFrame:
    kind = F.lower("event_type")
    return t.events.where(kind.contains("c") & ~kind.contains("error")).select("event_id", "value")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events""")
def sentinel_clean_nullif(t: Tables) -> DataFrame:
    dirty = t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, -9999.0).when(F.col("event_id") % 11 == 0, -99.99).otherwise(F.col("value")).alias("value"))
    return clean.missing_to_null(dirty, ["value"], equal=(-99.99,))


@query("""SELECT l_partkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > 0.01 AND l_tax > 0.01 AND l_quantity >= 4 AND l_quantity <> 13""")
def valid_targets(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_partkey", "l_linenumber", F.when(F.col("l_discount") > 0.01, F.col("l_discount")).otherwise(-9999.0).alias("l_discount"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_quantity") == 13, -9999.0).otherwise(F.col("l_quantity")).alias("data_ct"),
    )
    return clean.enough_data(clean.keep_valid_targets(rows, ["l_discount", "l_tax"]), "data_ct", 4).drop("data_ct")


@query("""SELECT p_partkey, s_suppkey, l_orderkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_size BETWEEN 5 AND 20 AND s_acctbal > 0 AND l_quantity >= 10 AND l_returnflag IN ('A', 'R')""")
def sql_three_way_join_where(t: Tables) -> DataFrame:
    for name in ("lineitem", "part", "supplier"):
        t(name).createOrReplaceTempView(f"soil_{name}")
    return t.spark.sql("""SELECT p_partkey, s_suppkey, l_orderkey, l_quantity FROM soil_lineitem JOIN soil_part ON l_partkey = p_partkey JOIN soil_supplier ON l_suppkey = s_suppkey
WHERE p_size BETWEEN 5 AND 20 AND s_acctbal > 0 AND l_quantity >= 10 AND l_returnflag IN ('A', 'R')""")


@query("""SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN
(SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1) ON c_custkey = o_custkey""")
def left_join_dedup_right(t: Tables) -> DataFrame:
    right = t.orders.withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.left_first(t.customer.select("c_custkey", "c_mktsegment"), right, ["c_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT s_suppkey, n_name AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def left_join_replacing(t: Tables) -> DataFrame:
    right = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return joins.left_keeping(t.supplier, right, ["s_nationkey"]).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def many_to_one_join(t: Tables) -> DataFrame:
    return joins.many_to_one(t.supplier.select("s_suppkey", "s_nationkey"), t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), ["s_nationkey"])


@query("""SELECT l_partkey, l_linenumber, l_orderkey FROM lineitem WHERE (l_partkey, l_linenumber) IN (SELECT (l_partkey, l_linenumber) FROM lineitem GROUP BY l_partkey, l_linenumber HAVING count(*) >= 4)""")
def semi_min_points(t: Tables) -> DataFrame:
    return joins.at_least(t.lineitem.select("l_partkey", "l_linenumber", "l_orderkey"), ["l_partkey", "l_linenumber"], 4)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_unmatched_report(t: Tables) -> DataFrame:
    return joins.unmatched(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, date, clicks, errors FROM a FULL JOIN b USING (user_id, date)""")
def full_outer_calendar(t: Tables) -> DataFrame:
    per = lambda kind, out: t.events.where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias(out))
    return per("click", "clicks").join(per("error", "errors"), ["user_id", "date"], "full")


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, date, clicks, errors FROM a JOIN b USING (user_id, date)""")
def date_alignment_join(t: Tables) -> DataFrame:
    per = lambda kind, out: t.events.where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias(out))
    return per("click", "clicks").join(per("error", "errors"), ["user_id", "date"])


@query("""WITH m AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT l.l_suppkey, l.l_linenumber, l.l_orderkey, round(l.l_discount - m.d, 6) AS anomaly FROM lineitem l LEFT JOIN m USING (l_suppkey, l_linenumber)""")
def multi_key_join(t: Tables) -> DataFrame:
    keys = ["l_suppkey", "l_linenumber"]
    mean = t.lineitem.groupBy(*keys).agg(F.avg("l_discount").alias("d"))
    return t.lineitem.join(mean, keys, "left").select(*keys, "l_orderkey", F.round(F.col("l_discount") - F.col("d"), 6).alias("anomaly"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, band FROM lineitem JOIN (VALUES (1, 0.0, 5.0), (2, 5.0, 15.0), (3, 15.0, 30.0), (4, 30.0, 60.0), (5, 60.0, 100.0), (6, 100.0, 200.0)) AS b(band, lo, hi)
ON l_quantity >= lo AND l_quantity < hi""")
def range_band_join(t: Tables) -> DataFrame:
    return joins.band_join(t.lineitem, depth.band_table(t.spark), F.col("l_quantity")).select("l_orderkey", "l_linenumber", "l_partkey", "band")


@query("""SELECT p_partkey, level FROM (SELECT p_partkey, level, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size * 5 - centre), level) AS n FROM part,
(VALUES (1, 1.25), (2, 6.25), (3, 16.25), (4, 33.75), (5, 62.5), (6, 115.0), (7, 200.0)) AS c(level, centre)) WHERE n = 1""")
def nearest_level_join(t: Tables) -> DataFrame:
    return joins.nearest_join(t.part.select("p_partkey", "p_size"), depth.level_table(t.spark).select("level", "centre"), F.col("p_size") * 5, "centre", "level").select("p_partkey", "level")


@query("""WITH a AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS k, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS k, max(event_id) AS m FROM events GROUP BY 1)
SELECT a.k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_key_join(t: Tables) -> DataFrame:
    k = F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("k")
    a = t.events.groupBy(k).agg(F.count("*").alias("n"))
    b = t.events.groupBy(k).agg(F.max("event_id").alias("m"))
    return a.join(b, a["k"].eqNullSafe(b["k"])).select(a["k"], "n", "m")


@query("""SELECT s_suppkey, replace(lower(n_name), '_', '-') AS key FROM supplier JOIN nation ON replace(lower(n_name), '_', '-') = 'nation-' || CAST(s_nationkey AS VARCHAR)""")
def key_normalise_join(t: Tables) -> DataFrame:
    left = t.supplier.select("s_suppkey", F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("key"))
    return left.join(t.nation.select(clean.join_key(F.col("n_name")).alias("key")), "key").select("s_suppkey", "key")


@query("""SELECT p_partkey, g.level FROM part LEFT JOIN (VALUES (5, 2), (10, 2), (20, 3), (45, 4), (50, 5), (70, 5), (91, 6), (100, 6)) AS g(d, level) ON p_size = g.d""")
def map_lookup_join(t: Tables) -> DataFrame:
    lookup = t.spark.createDataFrame(list(depth.SENSOR_LEVEL.items()), "p_size int, level int")
    return t.part.select("p_partkey", "p_size").join(F.broadcast(lookup), "p_size", "left").select("p_partkey", "level")


@query("""SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, lower(n_name) AS k, round_even(s_acctbal, -3) AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey) a
JOIN (SELECT c_custkey, lower(n_name) AS k, round_even(c_acctbal, -3) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON a.k = b.k AND a.d = b.d""")
def composite_rounded_join(t: Tables) -> DataFrame:
    n = t.nation
    a = t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("k"), F.bround("s_acctbal", -3).alias("d"))
    b = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("k"), F.bround("c_acctbal", -3).alias("d"))
    return a.join(b, ["k", "d"]).select("s_suppkey", "c_custkey")


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_join_chain(t: Tables) -> DataFrame:
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(joins.in_all([of("F"), of("P")], "c_custkey"), "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("""SELECT p_partkey, count(*) FILTER (abs(l_quantity - p_size) <= 1.0) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def tolerance_match_count(t: Tables) -> DataFrame:
    both = t.part.select("p_partkey", "p_size").join(t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity"), "p_partkey")
    return both.groupBy("p_partkey").agg(F.count_if(F.abs(F.col("l_quantity") - F.col("p_size")) <= 1.0).alias("n"))


@query("""SELECT o_orderkey AS id, o_totalprice AS value, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS kind FROM orders UNION ALL SELECT event_id, value, NULL, event_type FROM events""")
def union_all_nullfill(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    return reshape.union_filled([a, t.events.select(F.col("event_id").alias("id"), "value", F.col("event_type").alias("kind"))])


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT event_id, value FROM events")
def union_common_cols(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return reshape.union_common([a, t.events.select(F.col("event_id").alias("id"), "value", "event_type")])


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_keys(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()).distinct()


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_stations(t: Tables) -> DataFrame:
    return t.events.select("event_type", "user_id").distinct()


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topn_importance(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_by_time(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT l_partkey, l_linenumber, l_orderkey FROM lineitem WHERE NOT (l_quantity BETWEEN 10 AND 40) OR l_linenumber IN (1, 3)")
def isin_and_range(t: Tables) -> DataFrame:
    return t.lineitem.where(~F.col("l_quantity").between(10, 40) | F.col("l_linenumber").isin(1, 3)).select("l_partkey", "l_linenumber", "l_orderkey")


@query("SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lower(source) LIKE '%src1%')")
def id_exclusion(t: Tables) -> DataFrame:
    out = t.documents.where(F.lower("source").contains("src1")).select("doc_id")
    return t.labels.na.drop("any", subset=["quality"]).where("toxic = 0").join(out, "doc_id", "left_anti").select("doc_id")
