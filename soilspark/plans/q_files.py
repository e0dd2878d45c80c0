"""Files written and read back, merged and looked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soilspark.functions import clean, depth
from soilspark.plans import assemble, compare, site
from soilspark.plans.catalog import Tables, query
from soilspark.plans.q_scalars import ALBERS, EDGES, RINGS, _points
from soilspark.sources import archives, files, grids, rasters, scratch, shapes, sinks, state


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "csv")
    sinks.csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return files.csv(t.spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")


@query("SELECT c_custkey, c_acctbal FROM customer")
def nested_folders_scan(t: Tables) -> DataFrame:
    """Parquet files at several depths below a folder."""
    path = scratch.folder(t.spark, "tree")
    rows = t.customer.select("c_custkey", "c_acctbal")
    sinks.parquet(rows.where("c_custkey % 3 = 0"), f"{path}/a")
    sinks.parquet(rows.where("c_custkey % 3 = 1"), f"{path}/a/b/c")
    sinks.parquet(rows.where("c_custkey % 3 = 2"), f"{path}/d")
    return files.tree(t.spark, path)


@query("SELECT p_partkey, p_size, p_brand FROM part")
def table_by_ending(t: Tables) -> DataFrame:
    """The reader is chosen by the ending: half of the rows as CSV, half as Parquet."""
    path = scratch.folder(t.spark, "ending")
    rows = t.part.select("p_partkey", "p_size", "p_brand")
    sinks.csv(rows.where("p_partkey % 2 = 0"), f"{path}/even.csv")
    sinks.parquet(rows.where("p_partkey % 2 = 1"), f"{path}/odd.parquet")
    schema = "p_partkey long, p_size int, p_brand string"
    return files.table(t.spark, f"{path}/even.csv", schema).unionByName(files.table(t.spark, f"{path}/odd.parquet"))


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def files_of_differing_columns(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "many")
    sinks.csv(t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), f"{path}/1")
    sinks.csv(t.customer.where("c_custkey % 2 = 1").select("c_custkey", "c_mktsegment"), f"{path}/2")
    sinks.csv(t.customer.limit(1).select("c_custkey", F.lit("x").alias("uid")), f"{path}/3")  # passed over
    return files.concatenated(t.spark, [f"{path}/{k}" for k in (1, 2, 3)]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def folder_for_each_group(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "groups")
    sinks.by_group(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey", path)
    return t.spark.read.parquet(path)


@query("SELECT 'customer-' || c_nationkey AS key, c_custkey FROM customer")
def file_name_as_key(t: Tables) -> DataFrame:
    """Files of names of their own: the name without ending is the key of each row."""
    path = scratch.folder(t.spark, "named")
    sinks.named_files(t.customer.select(F.concat(F.lit("customer-"), "c_nationkey").alias("name"), "c_custkey"), "name", path)
    return files.keyed_by_name(files.csv(t.spark, path, "c_custkey long"), "key").select("key", "c_custkey")


@query("""SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS theta, count(value) AS n FROM events GROUP BY ALL""")
def stored_daily_states(t: Tables) -> DataFrame:
    """Records that come in three batches, one of them twice, merged into a stored state."""
    root, by = scratch.folder(t.spark, "state"), ["user_id", "date"]
    rows = t.events.select("user_id", F.to_date("ts").alias("date"), F.col("value").alias("theta"), (F.col("event_id") % 3).alias("part"))
    for k in (2, 0, 2, 1):
        state.merge(sinks.daily_state(rows.where(F.col("part") == k), by, ["theta"]), root, by, batch=f"part-{k}", buckets=8)
    back = state.read(t.spark, root)
    return sinks.state_means(back, by).join(back.select(*by, F.col("theta_n").alias("n")), by).select(*by, F.round("theta", 6).alias("theta"), "n")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS s, count(value) AS n, sum(value) FILTER (event_id % 3 = 1) AS s2, count(value) FILTER (event_id % 3 = 1) AS n2 FROM events GROUP BY ALL)
SELECT user_id, date, round(s / nullif(n, 0), 6) AS soil_vwc_0010, round(s2 / nullif(n2, 0), 6) AS soil_vwc_0020 FROM d""")
def merged_daily_states(t: Tables) -> DataFrame:
    """A record merged in three parts, one of which brings another depth."""
    rows = t.events.withColumn("date", F.to_date("ts")).withColumnRenamed("value", "soil_vwc_0010").withColumn("soil_vwc_0020", F.col("soil_vwc_0010"))
    by = ["user_id", "date"]
    part = lambda k, columns: sinks.daily_state(rows.where(F.col("event_id") % 3 == k), by, columns)
    state = sinks.merged_state(part(0, ["soil_vwc_0010"]), part(1, ["soil_vwc_0010", "soil_vwc_0020"]), by)
    means = sinks.state_means(sinks.merged_state(state, part(2, ["soil_vwc_0010"]), by), by)
    return means.select(*by, *[F.round(c, 6).alias(c) for c in ("soil_vwc_0010", "soil_vwc_0020")])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def only_what_is_missing(t: Tables) -> DataFrame:
    return sinks.missing_only(t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']},"properties":{"s_name":"' || s_name || '"}}' AS value FROM supplier""")
def geojson_points(t: Tables) -> DataFrame:
    return sinks.geojson(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_name"), "s_suppkey", "s_nationkey")


@query("""WITH f AS (SELECT 'p/' || p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'u' || p_partkey WHEN 1 THEN 'u' || (p_partkey // 2) || '_' || p_size ELSE 'x-u' || p_partkey || '-y' END AS name FROM part),
i AS (SELECT 'u' || p_partkey AS id FROM part), b AS (SELECT id, path, name, CASE WHEN name = id THEN 1 WHEN starts_with(name, id || '_') THEN 2 WHEN contains(name, id) THEN 3 END AS r FROM i JOIN f ON contains(name, id))
SELECT id, arg_min(path, r || name) AS path FROM b WHERE r < 3 GROUP BY id UNION ALL SELECT id, arg_min(path, name) FROM b WHERE id NOT IN (SELECT id FROM b WHERE r < 3) GROUP BY id
UNION ALL SELECT id, NULL FROM i WHERE id NOT IN (SELECT id FROM b)""")
def file_of_each_id(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("u"), k)).when(k % 3 == 1, F.concat(F.lit("u"), F.floor(k / 2), F.lit("_"), "p_size")).otherwise(F.concat(F.lit("x-u"), k, F.lit("-y")))
    found = t.part.select(F.concat(F.lit("p/"), k).alias("path"), name.alias("name"))
    return files.for_ids(t.part.select(F.concat(F.lit("u"), k).alias("id")), found, "id")


@query("SELECT 'm_r2=' || (p_partkey % 97) || '.' || (p_partkey % 10) AS name, ((p_partkey % 97) || '.' || (p_partkey % 10))::DOUBLE AS score FROM part ORDER BY score DESC, p_partkey DESC LIMIT 1")
def checkpoint_of_best_score(t: Tables) -> DataFrame:
    name = F.concat(F.lit("m_r2="), F.col("p_partkey") % 97, F.lit("."), F.col("p_partkey") % 10)
    found = t.part.select(name.alias("name"), F.col("p_partkey").alias("modified"))
    return files.best_checkpoint(found, "r2").select("name", "score")


@query("SELECT s_suppkey, s_acctbal AS depth, s_name AS station FROM supplier")
def columns_by_alias(t: Tables) -> DataFrame:
    """Of several names for a column the first that is there, and only wanted columns."""
    rows = clean.first_present(t.supplier, {"depth": ["depth_cm", "s_acctbal"], "station": ["s_name", "name"], "none": ["nowhere"]})
    return clean.keep_present(rows, ["s_suppkey", "depth", "station", "none"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0 WHEN p_partkey % 3 = 1 THEN 0.0 WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END::DOUBLE AS mid FROM part")
def horizon_midpoints(t: Tables) -> DataFrame:
    """Both bounds, the upper one alone, the lower one alone, or none."""
    k = F.col("p_partkey")
    top = F.when(k % 3 != 2, F.lit(0.0))
    bottom = F.when((k % 3 == 0) | (k % 3 == 2) & (k % 5 != 0), F.col("p_size").cast("double"))
    return t.part.select("p_partkey", depth.midpoint(top, bottom).alias("mid"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS date, CAST(round_even((event_id % 50 + event_id % 50 + 10) / 2.0, 0) AS INTEGER) AS depth_cm, value, event_type FROM events WHERE event_id % 11 <> 0)
SELECT user_id::VARCHAR AS station, date, depth_cm, round(coalesce(avg(value) FILTER (event_type = 'click'), avg(value)), 6) AS theta FROM r WHERE depth_cm BETWEEN 10 AND 40 GROUP BY ALL""")
def network_daily(t: Tables) -> DataFrame:
    """Daily means of flagged records by station and depth, of depths within a window; records without a depth go."""
    d = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 50).cast("double")
    raw = t.events.select(F.col("user_id").cast("string").alias("station"), (d / 100).alias("depth_from"), ((d + 10) / 100).alias("depth_to"), F.col("ts").alias("date_time"), F.col("value").alias("soil_moisture"), F.col("event_type").alias("soil_moisture_flag"))
    return site.network_days(raw, "click", (10, 40)).withColumn("theta", F.round("theta", 6))


@query(f"""WITH p AS (SELECT c_custkey, lon, lat FROM {ALBERS}), e(tile, i, x1, y1, x2, y2) AS (VALUES {EDGES}),
h AS (SELECT c_custkey, tile FROM p, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY c_custkey, tile HAVING count(*) % 2 = 1),
o AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS prio FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT p.c_custkey AS site_id, round(lon, 6) AS lon, round(lat, 6) AS lat, prio AS priority, tile FROM p JOIN (SELECT DISTINCT o_custkey FROM orders) s ON s.o_custkey = p.c_custkey LEFT JOIN o ON o.o_custkey = p.c_custkey LEFT JOIN h ON h.c_custkey = p.c_custkey""")
def site_table_with_tiles(t: Tables) -> DataFrame:
    """A row for each site of many observations: coordinates, the first known attribute, the tile."""
    rows = t.orders.withColumnRenamed("o_custkey", "c_custkey").join(_points(t), "c_custkey")
    rows = rows.select(F.col("c_custkey").alias("site_id"), "lon", "lat", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"), "o_orderkey")
    tiles = t.spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "tile string, ring array<struct<x:double,y:double>>")
    out = site.site_table(rows, "site_id", "lon", "lat", ["priority"], "o_orderkey", tiles)
    return out.select("site_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "priority", "tile")


@query("""WITH l AS (SELECT l_suppkey, l_linenumber * 5 AS depth_cm, l_quantity * 3 * 0.01 AS theta FROM lineitem WHERE l_linenumber IN (1, 2, 4)), s AS (SELECT l_suppkey, depth_cm, CAST(floor(round(theta / 0.05, 9)) AS INT) AS bin, count(*) AS n FROM l WHERE theta BETWEEN 0 AND 1 AND depth_cm IN (5, 20) GROUP BY ALL)
SELECT l_suppkey, depth_cm, bin, n, round(n / sum(n) OVER (PARTITION BY l_suppkey, depth_cm), 6) AS share FROM s""")
def content_frequency_by_depth(t: Tables) -> DataFrame:
    k, v = F.col("l_linenumber"), F.col("l_quantity") * 3
    days = t.lineitem.select("l_suppkey", F.when(k == 1, v).alias("soil_vwc_0005"), F.when(k == 2, v).alias("soil_vwc_0010"), F.when(k == 4, v).alias("soil_vwc_0020"), v.alias("soil_vwc_units"))
    curves = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.lit(5.0), F.lit(20.2), F.lit(50.0))).alias("depth_cm"))
    return site.content_by_depth(days, curves, "l_suppkey").withColumn("share", F.round("share", 6))


FITTED = "SELECT l_suppkey, (l_partkey % 40) * 6.0 AS depth_cm, avg(l_discount) AS theta_r, 0.3 + avg(l_tax) AS theta_s, 0.01 + avg(l_tax) / 10 AS alpha, 1.1 + avg(l_discount) AS n, count(*) AS n_obs FROM lineitem GROUP BY ALL"


def _documents(t: Tables) -> DataFrame:
    """Curves of stations at several depths, written as a JSON document a station and scanned."""
    by = [F.col("l_suppkey").alias("station"), ((F.col("l_partkey") % 40) * 6.0).alias("depth_cm")]
    rows = t.lineitem.groupBy(*by).agg(
        F.avg("l_discount").alias("theta_r"), (0.3 + F.avg("l_tax")).alias("theta_s"), (0.01 + F.avg("l_tax") / 10).alias("alpha"), (1.1 + F.avg("l_discount")).alias("n"), F.count("*").cast("int").alias("n_obs")
    )
    none = F.lit(None).cast("double")
    status = F.when(F.col("n_obs") % 7 == 0, "Failed").otherwise("Success")
    rows = rows.withColumns({"status": status, "aic": -F.col("n_obs").cast("double"), "theta_r_stderr": F.lit(0.5)} | {c: none for c in ("chi_squared", "reduced_chi_squared", "bic", "theta_s_stderr", "alpha_stderr", "n_stderr")})
    path = scratch.folder(t.spark, "documents")
    sinks.named_documents(rows, "station", path)
    return files.fit_documents(t.spark, path, "station")


@query(f"SELECT CAST(l_suppkey AS VARCHAR) AS station, depth_cm::DOUBLE AS depth_cm, round(theta_r, 9) AS theta_r, round(theta_s, 9) AS theta_s, round(alpha, 9) AS alpha, round(n, 9) AS n, 0.5::DOUBLE AS theta_r_stderr, n_obs::INTEGER AS n_obs, -n_obs::DOUBLE AS aic, -9999 AS data_ct FROM ({FITTED}) WHERE n_obs % 7 <> 0")
def fit_documents_scan(t: Tables) -> DataFrame:
    return _documents(t).select("station", "depth_cm", *[F.round(c, 9).alias(c) for c in ("theta_r", "theta_s", "alpha", "n")], "theta_r_stderr", "n_obs", "aic", "data_ct")


_BANDS = "(VALUES (0.0, 5.0), (5.0, 15.0), (15.0, 30.0), (30.0, 60.0), (60.0, 100.0)) AS b(lo, hi)"
_LEVELS = "(VALUES (1, 0.0, 2.5), (2, 2.5, 10.0), (3, 10.0, 22.5), (4, 22.5, 45.0), (5, 45.0, 80.0), (6, 80.0, 150.0), (7, 150.0, 250.0)) AS v(level, a, b)"


@query(f"""WITH f AS (SELECT * FROM ({FITTED}) JOIN {_LEVELS} ON depth_cm >= a AND depth_cm < b WHERE n_obs % 7 <> 0), o AS (SELECT *, (a + b) / 2 AS centre, row_number() OVER (PARTITION BY l_suppkey, level ORDER BY abs(depth_cm - (a + b) / 2), depth_cm) AS r FROM f),
m AS (SELECT s_suppkey, level, 0.02 + 0.005 * level AS tr, 0.35 + s_acctbal / 100000 AS ts, 0.01 + 0.001 * level AS al, 1.1 + s_suppkey % 7 / 20.0 AS n FROM supplier, {_LEVELS} WHERE s_suppkey % 3 <> 0),
p AS (SELECT s_suppkey, lo, hi, 0.03 + lo / 10000 AS tr, 0.4 + hi / 10000 AS ts, 0.02 AS al, 1.2 + s_suppkey % 5 / 10.0 AS n FROM supplier, {_BANDS} WHERE s_suppkey % 4 <> 0),
j AS (SELECT o.level, x.param, x.y, x.m, x.p FROM o LEFT JOIN m ON m.s_suppkey = o.l_suppkey AND m.level = o.level LEFT JOIN p ON p.s_suppkey = o.l_suppkey AND centre >= lo AND centre < hi,
  LATERAL (VALUES ('theta_r', o.theta_r, m.tr, p.tr), ('theta_s', o.theta_s, m.ts, p.ts), ('alpha', o.alpha, m.al, p.al), ('n', o.n, m.n, p.n)) AS x(param, y, m, p) WHERE r = 1),
l AS (SELECT level, param, 'modelled' AS other, y, m AS v FROM j UNION ALL SELECT level, param, 'mapped', y, p FROM j)
SELECT level, param, other, count(v) AS n, round(1 - sum((v - y) ** 2) / nullif(var_pop(y) FILTER (v IS NOT NULL) * count(v), 0), 5) AS r2, round(sqrt(avg((v - y) ** 2)), 6) AS rmse, round(avg(v - y), 6) AS bias FROM l GROUP BY ALL""")
def stations_compared(t: Tables) -> DataFrame:
    """Fitted curves of stations, scanned from their documents, against a model's by level and a map's by band, parameter by parameter."""
    k = F.col("s_suppkey")
    station = k.cast("string").alias("station")
    modelled = t.supplier.where("s_suppkey % 3 <> 0").select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("level")).select(
        station, "level", (0.02 + 0.005 * F.col("level")).alias("theta_r"), (0.35 + F.col("s_acctbal") / 100000).alias("theta_s"), (0.01 + 0.001 * F.col("level")).alias("alpha"), (1.1 + k % 7 / 20.0).alias("n")
    )
    bands = F.broadcast(depth.band_table(t.spark).where("band <= 5").drop("band"))  # five rows
    mapped = t.supplier.where("s_suppkey % 4 <> 0").join(bands, F.lit(True)).select(
        station, "lo", "hi", (0.03 + F.col("lo") / 10000).alias("theta_r"), (0.4 + F.col("hi") / 10000).alias("theta_s"), F.lit(0.02).alias("alpha"), (1.2 + k % 5 / 10.0).alias("n")
    )
    both = compare.stations_side_by_side(_documents(t), modelled, mapped, "station")
    out = compare.agreement(both, "station", ["modelled", "mapped"], ["theta_r", "theta_s", "alpha", "n"], ["level"])
    return out.select("level", "param", "other", "n", F.round("r2", 5).alias("r2"), *[F.round(c, 6).alias(c) for c in ("rmse", "bias")])



@query("""SELECT p_partkey, p_brand, p_retailprice, 5::BIGINT AS places, round((p_partkey % 180) - p_size / 10.0, 6) AS x0, round((p_partkey % 90) + p_size / 5.0, 6) AS y1
FROM part WHERE (p_partkey % 180) - p_size / 10.0 >= 20 AND (p_partkey % 90) + p_size / 5.0 < 70""")
def shapes_in_a_box(t: Tables) -> DataFrame:
    """Polygons written as shapefiles, and those of them read that lie in a box."""
    x, y, a, b = (F.col("p_partkey") % 180).cast("double"), (F.col("p_partkey") % 90).cast("double"), F.col("p_size") / 10.0, F.col("p_size") / 5.0
    at = lambda u, v: F.struct((x + u).alias("x"), (y + v).alias("y"))
    path = scratch.folder(t.spark, "shapes")
    shapes.write(t.part.select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"), F.array(F.array(at(-a, -b), at(-a, b), at(a, b), at(a, -b), at(-a, -b))).alias("rings")), path)
    back = shapes.read(t.spark, path, partitionRecords="500").where("x0 >= 20 and y1 < 70")
    return back.select("p_partkey", "p_brand", F.col("price").alias("p_retailprice"), F.size(F.get("rings", F.lit(0))).cast("long").alias("places"), F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query("""WITH r AS (SELECT 's' || user_id AS station, date_trunc('minute', ts) AS minute, (event_id % 4) * 0.05 AS lo, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'G' END AS flag FROM events WHERE event_type <> 'error' AND (event_id % 4) * 0.05 < 0.12)
SELECT station, round(lo::DOUBLE, 2) AS depth_from, event_type AS variable, count(*) AS n, count(value) AS known, count(flag) AS good, round(avg(value), 6) AS mean, min(minute) AS first, max(minute) AS last FROM r GROUP BY ALL""")
def station_archives(t: Tables) -> DataFrame:
    """Records written as archives of a member a sensor, and those of some variables and depths read."""
    lo = (F.col("event_id") % 4) * 0.05
    none = F.lit(0.0)
    rows = t.events.select(
        F.lit("net").alias("network"), F.concat(F.lit("s"), "user_id").alias("station"), F.col("event_type").alias("variable"), lo.alias("depth_from"), (lo + 0.05).alias("depth_to"), F.lit("probe_1").alias("sensor"),
        none.alias("latitude"), none.alias("longitude"), none.alias("elevation"), F.col("ts").cast("timestamp").alias("date_time"), "value", F.when(F.col("event_id") % 3 == 0, "G").alias("flag"),
    )
    path = scratch.folder(t.spark, "archives")
    archives.write(rows, path)
    back = archives.read(t.spark, path).where("variable <> 'error' and depth_from < 0.12")
    by = ["station", F.round("depth_from", 2).alias("depth_from"), "variable"]
    at = F.col("date_time").cast("timestamp_ntz")
    return back.groupBy(*by).agg(F.count("*").alias("n"), F.count("value").alias("known"), F.count("flag").alias("good"), F.round(F.avg("value"), 6).alias("mean"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_suppkey % 3""")
def raster_sampled(t: Tables) -> DataFrame:
    """A raster of the parts' prices, some unknown, written as tiled files, and its values at many points, some outside."""
    k = F.col("p_partkey")
    path, grid = scratch.folder(t.spark, "raster"), rasters.Grid(-120.0, 50.0, 0.25, 0.5)
    rasters.write(t.part.select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.when(k % 13 != 0, F.col("p_retailprice")).alias("value")), path, grid, side=32, tile=16)
    cell = F.col("l_partkey") + F.col("l_suppkey") % 3
    x, y = -120 + (cell % 40) * 0.25 + F.col("l_linenumber") / 40.0, 50 - F.floor(cell / 40) * 0.5 - F.col("l_linenumber") / 20.0
    return rasters.sampled(t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")), path, "x", "y").select("l_orderkey", "l_linenumber", "value")


@query("""WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
r AS (SELECT 'us-' || user_id AS site_id, CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(30 * k AS INTEGER)) AS DATE) AS date, CASE WHEN value = 0 OR value = -99.99 OR value <= -9999 THEN NULL ELSE value END AS v FROM k),
q AS (SELECT site_id, quantile_cont(v, 0.9) AS p FROM r GROUP BY site_id)
SELECT site_id, date, round(avg(CASE WHEN p > 1.2 THEN v / 100 ELSE v END), 6) AS theta, round(sum(v * 1800 / 2450000), 8) AS et FROM r JOIN q USING (site_id) GROUP BY ALL HAVING coalesce(sum(v * 1800 / 2450000), 0) <> 0""")
def tower_files_to_days(t: Tables) -> DataFrame:
    """Half-hourly files of towers, with comment lines before their headers, told apart by their names and made daily."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    at = lambda n: F.date_format(F.timestamp_add("MINUTE", 30 * n, F.lit("2024-01-01 00:00:00").cast("timestamp")), "yyyyMMddHHmm")
    measured = F.coalesce(F.col("value").cast("string"), F.lit("-9999"))
    rows = t.events.select("user_id", "value", k.alias("k")).select("user_id", "k", F.concat_ws(",", at(F.col("k")), at(F.col("k") + 1), measured, measured).alias("line"))
    heads = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("line")) for i, x in ((-3, "# Site"), (-2, "# Version"), (-1, "TIMESTAMP_START,TIMESTAMP_END,SWC_1,LE_F"))])
    lines = rows.unionByName(t.events.select("user_id").distinct().select("user_id", F.inline(heads)))
    path = scratch.folder(t.spark, "towers")
    sinks.named_lines(lines.withColumn("name", F.concat(F.lit("AMF_US-"), F.col("user_id").cast("string"), F.lit("_BASE_HH"))), "name", "k", "line", path)
    days = site.tower_days(files.half_hourly(t.spark, path))
    return days.select("site_id", "date", F.round("theta", 6).alias("theta"), F.round("ET", 8).alias("et"))


@query("""SELECT 's' || user_id AS station, arg_min(CASE WHEN event_id % 3 <> 0 THEN 'n' || event_type END, ts) FILTER (event_id % 3 <> 0) AS network, arg_min(user_id / 10.0, ts) AS latitude, arg_min(-user_id / 4.0, ts) FILTER (event_id % 2 = 0) AS longitude,
count(DISTINCT CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 END) AS depths, min(ts)::DATE AS start, max(ts)::DATE AS stop FROM events GROUP BY user_id""")
def stations_summary(t: Tables) -> DataFrame:
    """A row a station of a network's records: first known attributes, the number of its depths, first and last day."""
    k, at = F.col("event_id"), (F.col("event_id") % 5) * 0.1
    rows = t.events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("station"), F.when(k % 3 != 0, F.concat(F.lit("n"), "event_type")).alias("network"), (F.col("user_id") / 10.0).alias("latitude"), F.when(k % 2 == 0, -F.col("user_id") / 4.0).alias("longitude"),
        F.when(k % 5 != 4, at).alias("depth_from"), F.when(k % 5 != 4, at + 0.1).alias("depth_to"), F.col("ts").alias("date_time"),
    )
    return site.station_table(rows)


@query("SELECT p_partkey, p_size AS depth_cm, p_retailprice * 2 AS lat_wet, p_partkey % 7 AS slope FROM part")
def selected_features(t: Tables) -> DataFrame:
    """The features that a model takes: no ids but the key, no targets, no excluded names or families, and of the two depths the continuous one."""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.col("p_name").alias("profile_id"), F.col("p_size").alias("depth_cm"), (k % 3).alias("rosetta_level"), F.col("p_retailprice").alias("theta_s"), (F.col("p_retailprice") * 2).alias("lat_wet"), (k % 5).alias("soil_clay"), (k % 7).alias("slope"), (k % 2).alias("lat"))
    names = assemble.feature_names(rows.columns, ["theta_s"], ["p_partkey", "profile_id"], "continuous", ("lat",), ("soil",))
    return rows.select("p_partkey", *names)


@query("""WITH c AS (SELECT p_partkey % 60 AS t, (p_partkey // 60) % 12 AS i, p_partkey // 720 AS j, avg(p_retailprice) AS v FROM part GROUP BY ALL), g AS (SELECT max(p_partkey // 720) AS w FROM part), n AS (SELECT count(DISTINCT t) AS n FROM c),
p AS (SELECT s_suppkey, s_suppkey % 12 AS i, least(s_suppkey % 5, w) AS j FROM supplier, g), s AS (SELECT DISTINCT t FROM c)
SELECT s_suppkey, s.t::DOUBLE AS t, round(v, 6) AS value FROM p CROSS JOIN s LEFT JOIN c ON c.t = s.t AND c.i = p.i AND c.j = p.j""")
def grid_series(t: Tables) -> DataFrame:
    """Prices on a grid of rows and columns over steps, written as NetCDF files, and the series of the cells nearest to many points."""
    k = F.col("p_partkey")
    cells = t.part.groupBy((k % 60).alias("t"), (F.floor(k / 60) % 12).alias("i"), F.floor(k / 720).alias("j")).agg(F.avg("p_retailprice").alias("value"))
    wide = t.part.agg(F.max(F.floor(k / 720))).first()[0] + 1
    path = scratch.folder(t.spark, "grid")
    grids.write(cells, path, "price", [49.0 - 0.5 * r for r in range(12)], [-120.0 + 0.25 * c for c in range(wide)], steps=16)
    s = F.col("s_suppkey")
    points = t.supplier.select("s_suppkey", (-120 + 0.25 * (s % 5) + 0.1).alias("x"), (49 - 0.5 * (s % 12) - 0.2).alias("y"))
    return grids.series(points, path, "price", "x", "y").select("s_suppkey", "t", F.round("value", 6).alias("value"))
