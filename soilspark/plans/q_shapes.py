"""Reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.operators import reshape
from soilspark.plans.catalog import Tables, query


@query("SELECT l_orderkey, l_partkey, variable, value FROM (SELECT l_orderkey, l_partkey, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_discount, l_tax))")
def melt_long(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return reshape.melt(rows, ["l_orderkey", "l_partkey"], ["l_discount", "l_tax"], keep_null=False)


@query("SELECT l_partkey, " + ", ".join(f'round(avg(l_discount) FILTER (l_linenumber = {k}), 6) AS L{k}' for k in range(1, 8)) + " FROM lineitem GROUP BY l_partkey")
def pivot_mean(t: Tables) -> DataFrame:
    wide = reshape.pivot_mean(t.lineitem, ["l_partkey"], "l_linenumber", list(range(1, 8)), "l_discount")
    return wide.select("l_partkey", *[F.round(str(k), 6).alias(f"L{k}") for k in range(1, 8)])


@query("""SELECT user_id, CAST(ts AS DATE) AS date, arg_min(value, event_id) FILTER (event_type = 'click') AS click_value, arg_min(props, event_id) FILTER (event_type = 'click') AS click_props,
arg_min(value, event_id) FILTER (event_type = 'error') AS error_value, arg_min(props, event_id) FILTER (event_type = 'error') AS error_props FROM events GROUP BY ALL""")
def pivot_first_pair(t: Tables) -> DataFrame:
    return reshape.pivot_first(t.events.withColumn("date", F.to_date("ts")), ["user_id", "date"], "event_type", ["click", "error"], ["value", "props"], "event_id")


@query("""SELECT p_partkey, h, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS h, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 2.0 END, p_retailprice / 2 FROM part) WHERE h IS NOT NULL AND v IS NOT NULL""")
def paired_cols_stack(t: Tables) -> DataFrame:
    wide = t.part.select("p_partkey", F.col("p_size").alias("h1"), F.col("p_retailprice").alias("t1"), F.when(F.col("p_size") > 10, F.col("p_size") * 2.0).alias("h2"), (F.col("p_retailprice") / 2).alias("t2"))
    return reshape.paired_columns(wide, ["p_partkey"], [("h1", "t1"), ("h2", "t2")], ("h", "v"))


def _levels(t: Tables, log: bool = False) -> DataFrame:
    """A wide table of parameters by level: US_L<level>_VG_<param>."""
    of = lambda c, k: F.avg(F.when(F.col("l_linenumber") == k, c))
    alpha, n = F.col("l_tax") + 0.01, 1.1 + F.col("l_discount")
    cols = []
    for k in (1, 2, 3):
        cols += [of(F.col("l_discount"), k).alias(f"US_L{k}_VG_theta_r"), of(F.col("l_discount") + 0.4, k).alias(f"US_L{k}_VG_theta_s")]
        cols += [of(F.log10(alpha) if log else alpha, k).alias(f"US_L{k}_VG_alpha"), of(F.log10(n) if log else n, k).alias(f"US_L{k}_VG_n")]
    return t.lineitem.groupBy("l_partkey").agg(*cols)


LEVELS = """SELECT l_partkey, l_linenumber AS level, avg(l_discount) AS theta_r, avg(l_discount + 0.4) AS theta_s, avg({a}) AS alpha, avg({n}) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL"""


@query(f"""SELECT l_partkey, CAST(level AS VARCHAR) AS level, round(theta_r, 6) AS theta_r, round(theta_s, 6) AS theta_s, round(alpha, 6) AS alpha, round(n, 6) AS n FROM ({LEVELS.format(a='l_tax + 0.01', n='1.1 + l_discount')})""")
def colname_parse_pivot(t: Tables) -> DataFrame:
    keys = ["theta_r", "theta_s", "alpha", "n"]
    long = reshape.named_columns(_levels(t), ["l_partkey"], r"US_L(\d)_VG_(.+)", ["level", "param"], "param", keys)
    return long.select("l_partkey", "level", *[F.round(k, 6).alias(k) for k in keys])


@query(f"""SELECT l_partkey, level, round(theta_r, 6) AS theta_r, round(theta_s, 6) AS theta_s, round(pow(10, alpha), 6) AS alpha, round(pow(10, n), 6) AS n FROM ({LEVELS.format(a='log10(l_tax + 0.01)', n='log10(1.1 + l_discount)')})""")
def level_wide_to_long(t: Tables) -> DataFrame:
    keys = ["theta_r", "theta_s", "alpha", "n"]
    long = reshape.named_columns(_levels(t, log=True), ["l_partkey"], r"US_L(\d)_VG_(.+)", ["level", "param"], "param", keys, least=4)
    back = long.withColumns({c: F.pow(F.lit(10.0), F.col(c)) for c in ("alpha", "n")})
    return back.select("l_partkey", F.col("level").cast("int").alias("level"), *[F.round(k, 6).alias(k) for k in keys])


@query("SELECT p_partkey, (p_type = 'ECONOMY')::INT AS p_type_ECONOMY, (p_type = 'STANDARD')::INT AS p_type_STANDARD, (p_type = 'NONE')::INT AS p_type_NONE FROM part")
def one_hot_align(t: Tables) -> DataFrame:
    return reshape.one_hot(t.part.select("p_partkey", "p_type"), "p_type", ["ECONOMY", "STANDARD", "NONE"]).drop("p_type")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS e00, round(embedding[2]::DOUBLE, 6) AS e01, round(embedding[64]::DOUBLE, 6) AS e63 FROM embeddings")
def vector_to_columns(t: Tables) -> DataFrame:
    wide = reshape.vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64, "e")
    return wide.select("vec_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("e00", "e01", "e63")])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def struct_unpack(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "struct<k: bigint>").alias("p")).select("event_id", "p.*")
