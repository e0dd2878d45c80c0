"""Scalar functions over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.functions import clean, depth, geo, vg
from soilspark.plans.catalog import Tables, query

PARAMS = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 10 AS psi, l_discount AS tr, 0.4 + l_tax AS ts, 0.001 + l_tax / 10 AS a, 1.0 + l_quantity / 25 AS n FROM lineitem"
FORWARD = "CASE WHEN n > 1 THEN tr + (ts - tr) / pow(1 + pow(a * greatest(psi, 1e-9), n), 1 - 1 / n) END"


def params(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 10).alias("psi"), F.col("l_discount").alias("tr"), (0.4 + F.col("l_tax")).alias("ts"),
        (0.001 + F.col("l_tax") / 10).alias("a"), (1.0 + F.col("l_quantity") / 25).alias("n"),
    )


def _four() -> list:
    return [F.col(c) for c in ("tr", "ts", "a", "n")]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({FORWARD}, 6) AS theta FROM ({PARAMS})")
def vg_forward(t: Tables) -> DataFrame:
    return params(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(vg.theta(F.col("psi"), *_four()), 6).alias("theta"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(tr + (greatest(ts, tr) - tr) / pow(1 + pow(greatest(a - 0.003, 1e-9) * greatest(psi, 1e-9), greatest(n - 1, 1.001)), 1 - 1 / greatest(n - 1, 1.001)), 6) AS theta FROM ({PARAMS})""")
def vg_forward_clamped(t: Tables) -> DataFrame:
    tr, ts, a, n = _four()
    return params(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(vg.theta_clamped(F.col("psi"), tr, ts, a - 0.003, n - 1), 6).alias("theta"))


HELD = "least(greatest(0.25, tr + 1e-6), ts - 1e-6)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(log10(pow(pow(({HELD} - tr) / (ts - tr), -n / (n - 1)) - 1, 1 / n) / a), 5) AS pf FROM ({PARAMS})")
def vg_inverse(t: Tables) -> DataFrame:
    return params(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log10(vg.psi(F.lit(0.25), *_four())), 5).alias("pf"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN tr < 0.3 AND 0.3 < ts THEN round(log10(pow(pow((ts - tr) / (0.3 - tr), n / (n - 1)) - 1, 1 / n) / a), 5) END AS pf FROM ({PARAMS})")
def vg_inverse_ratio(t: Tables) -> DataFrame:
    return params(t).select("l_orderkey", "l_linenumber", "l_partkey", F.when((F.col("tr") < 0.3) & (F.col("ts") > 0.3), F.round(vg.log10_psi(F.lit(0.3), *_four()), 5)).alias("pf"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, true AS agrees FROM lineitem")
def vg_roundtrip(t: Tables) -> DataFrame:
    rows = params(t).withColumn("w", F.col("tr") + (F.col("ts") - F.col("tr")) * 0.5)
    back = vg.theta(vg.psi(F.col("w"), *_four()), *_four())
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.abs(back - F.col("w")) < 1e-6).alias("agrees"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(log10(greatest(l_tax, 1e-10)), 6) AS log10_alpha, round(pow(10, log10(greatest(l_tax, 1e-10))), 6) AS alpha FROM lineitem")
def log10_formats(t: Tables) -> DataFrame:
    logs = vg.to_log10(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("alpha")), ("alpha",))
    back = vg.from_log10(logs, ("alpha",))
    return back.select("l_orderkey", "l_linenumber", "l_partkey", F.round("log10_alpha", 6).alias("log10_alpha"), F.round("alpha", 6).alias("alpha"))


@query("WITH q AS (SELECT user_id, quantile_cont(value, 0.9) AS q FROM events GROUP BY user_id) SELECT event_id, round(CASE WHEN q > 40 THEN value / 100 ELSE value END, 6) AS value FROM events JOIN q USING (user_id)")
def percent_heuristic(t: Tables) -> DataFrame:
    return clean.percent_to_fraction(t.events.select("event_id", "user_id", "value"), "value", ["user_id"], above=40).select("event_id", F.round("value", 6).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(abs(-l_quantity) * 10.19716, 4) AS kpa, round(l_extendedprice * 10197.16, 2) AS mpa, round(l_tax * 100, 6) AS m, round(l_quantity / 100 * (1 + l_tax), 6) AS theta, round(l_extendedprice * 1800 / 2.45e6, 6) AS et FROM lineitem""")
def unit_conversions(t: Tables) -> DataFrame:
    q, e, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(clean.to_cm(-q, "kPa"), 4).alias("kpa"), F.round(clean.to_cm(e, "MPa"), 2).alias("mpa"), F.round(clean.to_cm(x, "m"), 6).alias("m"),
        F.round(clean.volumetric(q, 1 + x), 6).alias("theta"), F.round(clean.et_from_latent_heat(e, F.lit(1800)), 6).alias("et"),
    )


@query("""SELECT p_partkey, CASE WHEN d < 2.5 THEN 1 WHEN d < 10 THEN 2 WHEN d < 22.5 THEN 3 WHEN d < 45 THEN 4 WHEN d < 80 THEN 5 WHEN d < 150 THEN 6 ELSE 7 END AS level,
CASE p_size WHEN 5 THEN 2 WHEN 10 THEN 2 WHEN 20 THEN 3 WHEN 45 THEN 4 WHEN 50 THEN 5 WHEN 70 THEN 5 WHEN 91 THEN 6 WHEN 100 THEN 6 END AS sensor FROM (SELECT *, p_size * 6.0 AS d FROM part)""")
def depth_levels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", depth.level(F.col("p_size") * 6.0).alias("level"), depth.sensor_level(F.col("p_size")).alias("sensor"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS lo, CAST(p_size + 10 AS DOUBLE) AS hi, p_size AS cm FROM part""")
def regex_suffix_parse(t: Tables) -> DataFrame:
    name = F.concat(F.lit("alpha_"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_size") + 10).cast("string"), F.lit("cm"))
    lo, hi = depth.suffix_bounds(name)
    return t.part.select("p_partkey", lo.alias("lo"), hi.alias("hi"), depth.trailing_number(F.concat(F.lit("soil_vwc_"), F.lpad(F.col("p_size").cast("string"), 4, "0"))).alias("cm"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount - l_tax) / nullif(l_discount + l_tax, 0), 6) AS nd, round(2.5 * (l_discount - l_tax) / nullif(l_discount + 6 * l_tax - 7.5 * 0.01 + 1, 0), 6) AS evi FROM lineitem")
def norm_difference(t: Tables) -> DataFrame:
    d, x = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(geo.normalised_difference(d, x), 6).alias("nd"), F.round(geo.enhanced_index(d, x, F.lit(0.01)), 6).alias("evi"))


@query("SELECT event_id, (CAST(json_extract(props, '$.k') AS BIGINT) & 62) = 0 AND user_id % 4 = 0 AS clear, round(CAST(json_extract(props, '$.k') AS BIGINT) * 0.0000275::DOUBLE - 0.2, 7) AS sr FROM events")
def qa_bitmask(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select("event_id", geo.clear_pixel(k, F.col("user_id") % 4).alias("clear"), F.round(geo.surface_reflectance(k), 7).alias("sr"))


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 17 AS b, p_partkey % 7 AS c FROM part), r AS (SELECT *, CAST(round_even(a * 100.0 / nullif(a + b + c, 0), 0) AS INT) AS x, CAST(round_even(b * 100.0 / nullif(a + b + c, 0), 0) AS INT) AS y, CAST(round_even(c * 100.0 / nullif(a + b + c, 0), 0) AS INT) AS z FROM p)
SELECT p_partkey, CASE WHEN x >= y AND x >= z THEN 100 - y - z ELSE x END AS sand, CASE WHEN y > x AND y >= z THEN 100 - x - z ELSE y END AS silt, CASE WHEN z > x AND z > y THEN 100 - x - y ELSE z END AS clay FROM r""")
def texture_normalise(t: Tables) -> DataFrame:
    sand, silt, clay = geo.texture_percent(F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return t.part.select("p_partkey", sand.alias("sand"), silt.alias("silt"), clay.alias("clay"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM part")
def category_encode(t: Tables) -> DataFrame:
    from soilspark.plans.assemble import category_codes

    codes = category_codes(t.part, "p_brand")
    return t.part.join(F.broadcast(codes), "p_brand").select("p_partkey", "code")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props))::INT AS n FROM events")
def json_map_extract(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string, bigint>")
    return t.events.select("event_id", F.element_at(m, "k").alias("k"), F.size(F.map_keys(m)).alias("n"))


ALBERS = """(SELECT c_custkey, -100 + c_nationkey * 1.3 + (c_custkey % 100) / 100.0 AS lon, 30 + (c_custkey % 18) + c_nationkey / 50.0 AS lat FROM customer)"""


def _points(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (-100 + F.col("c_nationkey") * 1.3 + (F.col("c_custkey") % 100) / 100.0).alias("lon"), (30 + (F.col("c_custkey") % 18) + F.col("c_nationkey") / 50.0).alias("lat"))


@query(f"""WITH k AS (SELECT 0.6029027690657601::DOUBLE AS n, 1.3491820315609704::DOUBLE AS c, 1.556714288866605::DOUBLE * 6378137.0::DOUBLE AS rho0, sqrt(0.006694380022900788::DOUBLE) AS e, 0.006694380022900788::DOUBLE AS e2),
q AS (SELECT c_custkey, lon, n, rho0, c, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q FROM {ALBERS}, k)
SELECT c_custkey, round(sqrt(c - n * q) / n * 6378137.0 * sin(n * radians(lon + 96)), 2) AS x, round(rho0 - sqrt(c - n * q) / n * 6378137.0 * cos(n * radians(lon + 96)), 2) AS y FROM q""")
def albers_project(t: Tables) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return _points(t).select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(f"SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {ALBERS} WHERE lon BETWEEN -90 AND -80 AND lat BETWEEN 35 AND 45")
def bbox_select(t: Tables) -> DataFrame:
    return _points(t).where(geo.in_box(F.col("lon"), F.col("lat"), (-90, 35, -80, 45))).select("c_custkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


RINGS = {"a": [(-95.0, 32.0), (-82.0, 33.0), (-80.0, 44.0), (-93.0, 41.0)], "b": [(-79.0, 30.0), (-66.0, 31.0), (-72.0, 48.0)]}
EDGES = ", ".join(f"('{k}', {i}, {x1}, {y1}, {x2}, {y2})" for k, r in RINGS.items() for i, ((x1, y1), (x2, y2)) in enumerate(zip(r, r[1:] + r[:1], strict=True)))


@query(f"""WITH e(tile, i, x1, y1, x2, y2) AS (VALUES {EDGES}) SELECT c_custkey, tile FROM {ALBERS} p, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY c_custkey, tile HAVING count(*) % 2 = 1""")
def point_in_polygon(t: Tables) -> DataFrame:
    from soilspark.operators import spatial

    tiles = t.spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "tile string, ring array<struct<x:double,y:double>>")
    return spatial.within(_points(t), tiles, "lon", "lat").select("c_custkey", "tile")


@query(f"""SELECT c_custkey, round(avg(value), 6) AS value FROM (SELECT c_custkey, floor((50 - lat) / 0.5)::INT AS row, floor((lon + 110) / 0.5)::INT AS col FROM {ALBERS}) p JOIN (SELECT r::INT AS row, c::INT AS col, (r * 100 + c) / 7.0 AS value FROM range(0, 100) AS a(r), range(0, 120) AS b(c)) g USING (row, col) GROUP BY c_custkey""")
def pixel_sample(t: Tables) -> DataFrame:
    from soilspark.operators import spatial

    grid = t.spark.range(100 * 120).select(F.floor(F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col"))
    grid = grid.withColumn("value", (F.col("row") * 100 + F.col("col")) / 7.0)
    return spatial.sampled(_points(t), grid, "lon", "lat", -110, 50, 0.5, 0.5).select("c_custkey", F.round("value", 6).alias("value"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0""")
def cosine_pairs(t: Tables) -> DataFrame:
    from soilspark.operators import vectors

    return vectors.cosine_pairs(t.embeddings, "vec_id", "embedding", "label").withColumn("cosine", F.round("cosine", 5)).select("a", "b", "cosine")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy, DATE '1900-01-01' + CAST(o_custkey AS INTEGER) AS since, try_strptime(strftime(o_orderdate, '%Y%m%d') || '0130', '%Y%m%d%H%M') AS at FROM orders")
def date_functions(t: Tables) -> DataFrame:
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("0130"))
    return t.orders.select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"),
        F.date_add(F.lit("1900-01-01").cast("date"), F.col("o_custkey").cast("int")).alias("since"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz").alias("at"),
    )


@query("SELECT s_suppkey, 'soil_' || CAST(s_suppkey AS VARCHAR) || '_' || CAST(s_nationkey AS VARCHAR) AS sample_id, lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS padded, replace(replace(s_name, '#', '_'), ':', '_') AS safe FROM supplier")
def sample_ids(t: Tables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return t.supplier.select("s_suppkey", F.concat_ws("_", F.lit("soil"), key, F.col("s_nationkey").cast("string")).alias("sample_id"), F.lpad(key, 12, "0").alias("padded"), clean.safe_name(F.translate("s_name", "#", "_")).alias("safe"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(2, 65), lambda i: abs(embedding[i]::DOUBLE - embedding[i - 1]::DOUBLE))), 5) AS change, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS head FROM embeddings""")
def array_changes(t: Tables) -> DataFrame:
    from soilspark.operators import vectors

    return t.embeddings.select("vec_id", F.round(vectors.abs_change(F.col("embedding")), 5).alias("change"), F.round(vectors.total(F.slice("embedding", 1, 8)), 5).alias("head"))


@query("""SELECT p_partkey, round(100 - a - c / 2, 6) AS x, round(c * sqrt(3) / 2, 6) AS y FROM (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 40)::DOUBLE AS c FROM part)""")
def ternary_coordinates(t: Tables) -> DataFrame:
    x, y = geo.ternary(F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double"))
    return t.part.select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(sin(radians(40 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(40)) * sin(radians(-90 - lon) / 2) ** 2)) / 1000, 3) AS km FROM {ALBERS} WHERE 2 * 6371008.8 * asin(sqrt(sin(radians(40 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(40)) * sin(radians(-90 - lon) / 2) ** 2)) <= 500000""")
def buffer_select(t: Tables) -> DataFrame:
    d = geo.haversine(F.col("lon"), F.col("lat"), F.lit(-90.0), F.lit(40.0))
    return _points(t).withColumn("d", d).where("d <= 500000").select("c_custkey", F.round(F.col("d") / 1000, 3).alias("km"))


LINES = ", ".join(f"('{s}', {k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for s, lines in geo.CLASS_LINES.items() for k, (a, b) in enumerate(lines, 1))


@query(f"""WITH l AS (SELECT system, line, 100 - s0 - c0 / 2.0 AS x0, c0 * sqrt(3) / 2 AS y0, 100 - s1 - c1 / 2.0 AS x1, c1 * sqrt(3) / 2 AS y1
FROM (SELECT system, line, s0::DOUBLE AS s0, c0::DOUBLE AS c0, s1::DOUBLE AS s1, c1::DOUBLE AS c1 FROM (VALUES {LINES}) AS v(system, line, s0, c0, s1, c1))),
p AS (SELECT p_partkey, 100 - a - c / 2 AS x, c * sqrt(3) / 2 AS y FROM (SELECT p_partkey, (p_partkey % 61)::DOUBLE AS a, (p_size % 40)::DOUBLE AS c FROM part))
SELECT p_partkey, system, string_agg(CASE sign(round((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0), 6)) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END, '' ORDER BY line) AS sides FROM p, l GROUP BY ALL""")
def texture_class_lines(t: Tables) -> DataFrame:
    """On which side of each system's lines between texture classes each sample lies."""
    x, y = geo.ternary((F.col("p_partkey") % 61).cast("double"), (F.col("p_size") % 40).cast("double"))
    lines = F.broadcast(geo.class_lines(t.spark).groupBy("system").agg(F.sort_array(F.collect_list(F.struct("line", "x0", "y0", "x1", "y1"))).alias("lines")))  # a row a system
    side = lambda q: geo.side_of(F.col("x"), F.col("y"), q["x0"], q["y0"], q["x1"], q["y1"])
    told = F.array_join(F.transform("lines", lambda q: F.when(side(q) > 0, "+").when(side(q) < 0, "-").otherwise("0")), "")
    return t.part.select("p_partkey", x.alias("x"), y.alias("y")).join(lines, F.lit(True)).select("p_partkey", "system", told.alias("sides"))


@query(f"""WITH p AS (SELECT c_custkey, lon, lat, (lon < -85)::INTEGER AS tile FROM {ALBERS}), b AS (SELECT tile, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p GROUP BY tile),
c AS (SELECT c_custkey, tile, least(floor((lon - x0) / (x1 - x0) * 64), 63)::INTEGER AS i, least(floor((lat - y0) / (y1 - y0) * 64), 63)::INTEGER AS j FROM p JOIN b USING (tile)),
d AS (SELECT c_custkey, tile, array_to_string(list_transform(range(1, 7), lambda k: ((i >> (6 - k)) & 1) + 2 * ((j >> (6 - k)) & 1)), '') AS cell FROM c),
u AS (SELECT tile, k, cell[1 : k] AS q, count(*) AS n FROM d, (SELECT unnest(range(7)) AS k) GROUP BY ALL)
SELECT c_custkey, tile || CASE WHEN q = '' THEN '' ELSE '-' || q END AS part, n::BIGINT AS n FROM (SELECT d.c_custkey, u.tile, u.q, u.n, row_number() OVER (PARTITION BY c_custkey ORDER BY u.k) AS r
FROM d JOIN u ON u.tile = d.tile AND u.q = d.cell[1 : u.k] WHERE u.n <= 40 OR u.k = 6) WHERE r = 1""")
def tiles_in_quadrants(t: Tables) -> DataFrame:
    """Tiles split until a part has at most 40 points, written as a folder a part and read again."""
    from soilspark.operators import spatial
    from soilspark.sources import scratch, sinks

    parts = spatial.quadrants(_points(t).withColumn("tile", (F.col("lon") < -85).cast("int")), "tile", "lon", "lat", 40, 6)
    path = scratch.folder(t.spark, "parts")
    sinks.by_group(parts.select("c_custkey", "part"), "part", path)
    back = t.spark.read.schema("c_custkey long, part string").parquet(path)
    return back.join(back.groupBy("part").agg(F.count("*").alias("n")), "part")


@query("""WITH e AS (SELECT vec_id, vec_id % 3 AS batch, label, embedding::DOUBLE[] AS z, embedding[1:16]::DOUBLE[] AS s FROM embeddings), p AS (SELECT a.batch, a.vec_id, a.label = b.label AS kin, list_cosine_similarity(a.z, b.z) AS cz, list_cosine_similarity(a.s, b.s) AS cs
FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id), r AS (SELECT batch, vec_id, sum(exp(cz / 0.1)) AS w, sum(exp(cz / 0.1)) FILTER (kin) AS k FROM p GROUP BY ALL)
SELECT batch::BIGINT AS batch, round(c, 6) AS contrastive, n::BIGINT AS n, round(a, 6) AS alignment FROM (SELECT batch, avg(-ln(k / w)) AS c, count(*) AS n FROM r WHERE k > 0 GROUP BY batch) JOIN (SELECT batch, avg((cz - cs) ** 2) AS a FROM p GROUP BY batch) USING (batch)""")
def embedding_losses(t: Tables) -> DataFrame:
    from soilspark.operators import vectors

    rows = t.embeddings.withColumns({"batch": F.col("vec_id") % 3, "static": F.slice("embedding", 1, 16)})
    one, two = vectors.contrastive(rows, "batch", "vec_id", "embedding", "label", side=64), vectors.alignment(rows, "batch", "embedding", "static")
    return one.select("batch", F.round("loss", 6).alias("contrastive"), "n").join(two.select("batch", F.round("loss", 6).alias("alignment")), "batch")
