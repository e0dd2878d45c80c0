"""Ordered operations and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.operators import joins, series
from soilspark.plans.catalog import Tables, query

DAYS = """d AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY ALL),
e AS (SELECT user_id, min(date) AS a, max(date) AS z FROM d GROUP BY user_id),
s AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
x AS (SELECT s.user_id, s.date, d.v AS value FROM s LEFT JOIN d USING (user_id, date))"""


def _days(t: Tables, how: str = "mean") -> DataFrame:
    return series.daily(t.events, ["user_id"], "ts", "value", how=how)


@query(f"WITH {DAYS} SELECT user_id, date, round(value, 6) AS value FROM x")
def daily_resample_spine(t: Tables) -> DataFrame:
    return _days(t).withColumn("value", F.round("value", 6))


@query(f"WITH {DAYS}, q AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS v FROM events GROUP BY ALL) SELECT s.user_id, s.date, round(coalesce(v, 0), 6) AS value FROM s LEFT JOIN q USING (user_id, date)")
def daily_sum_spine(t: Tables) -> DataFrame:
    return series.daily(t.events, ["user_id"], "ts", "value", how="sum").withColumn("value", F.round("value", 6))


@query(f"WITH {DAYS} SELECT user_id, date, round(lag(value, 3) OVER w, 6) AS value_lag3, round(lag(value, 7) OVER w, 6) AS value_lag7 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY date)")
def lag_features(t: Tables) -> DataFrame:
    return series.lags(_days(t), ["user_id"], "date", ["value"], [3, 7]).select("user_id", "date", F.round("value_lag3", 6).alias("value_lag3"), F.round("value_lag7", 6).alias("value_lag7"))


@query(f"""WITH {DAYS}, y AS (SELECT s.user_id, s.date, x.value, c.n FROM s JOIN x USING (user_id, date) LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, count(*)::DOUBLE AS n FROM events GROUP BY ALL) c USING (user_id, date)),
l AS (SELECT user_id, value, lag(n, 0) OVER w AS n0, lag(n, 3) OVER w AS n3, lag(n, 7) OVER w AS n7 FROM y WINDOW w AS (PARTITION BY user_id ORDER BY date))
SELECT user_id, lag, round(r, 6) AS r FROM (SELECT user_id, corr(value, n0) AS r0, corr(value, n3) AS r3, corr(value, n7) AS r7 FROM l GROUP BY user_id), LATERAL (VALUES (0, r0), (3, r3), (7, r7)) AS v(lag, r)""")
def ccf_by_lag(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("n"))
    return series.lag_correlations(_days(t).join(n, ["user_id", "date"], "left"), ["user_id"], "date", "value", "n", [0, 3, 7]).withColumn("r", F.round("r", 6))


MASK = DAYS + """, q AS (SELECT user_id, quantile_cont(value, 0.6) AS q FROM x WHERE value IS NOT NULL GROUP BY user_id),
n AS (SELECT x.*, q, row_number() OVER (PARTITION BY user_id ORDER BY date) AS n FROM x LEFT JOIN q USING (user_id)),
m AS (SELECT *, CASE WHEN count(*) OVER w >= 2 AND count(*) OVER w = count(value) OVER w THEN regr_slope(value, n) OVER w END AS slope FROM n WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS 2 PRECEDING)),
f AS (SELECT *, coalesce(value < q AND slope < 0, FALSE) AS m FROM m), i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, m ORDER BY date) AS i FROM f)"""


@query(f"WITH {MASK} SELECT user_id, date, m AND count(*) OVER (PARTITION BY user_id, m, i) >= 2 AS drydown FROM i")
def drydown_mask(t: Tables) -> DataFrame:
    return series.drydown(_days(t, "ordered"), ["user_id"], "date", "value", below=0.6, least=2).select("user_id", "date", "drydown")


@query(f"WITH {MASK} SELECT user_id, min(date) AS start, max(date) AS stop, count(*) AS n FROM i WHERE m GROUP BY user_id, i")
def run_lengths(t: Tables) -> DataFrame:
    return series.runs(series.drydown(_days(t, "ordered"), ["user_id"], "date", "value", below=0.6, least=1), ["user_id"], "date", F.col("drydown"))


@query(f"""WITH {DAYS}, y AS (SELECT x.user_id, x.date, coalesce(x.value, 0) AS a, coalesce(c.n, 0)::DOUBLE AS b FROM x LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL) c USING (user_id, date)),
g AS (SELECT user_id, date, row_number() OVER w - 1 AS start, abs(a - lag(a) OVER w) AS da, abs(b - lag(b) OVER w) AS db FROM y WINDOW w AS (PARTITION BY user_id ORDER BY date)),
o AS (SELECT user_id, start, 0.7 * sum(da) OVER i + 0.3 * sum(db) OVER i AS score, count(*) OVER k AS c FROM g WINDOW i AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), k AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT user_id, start::INT AS start, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, start) AS rank FROM o WHERE c = 7 AND start % 3 = 0) WHERE rank <= 2""")
def window_score_topk(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    rows = _days(t).join(n, ["user_id", "date"], "left").select("user_id", "date", F.coalesce("value", F.lit(0.0)).alias("a"), F.coalesce("n", F.lit(0)).cast("double").alias("b"))
    w = series.scored_windows(rows, ["user_id"], "date", ("a", "b"), 7, 3).withColumn("score", F.round("score", 6))
    return series.top(w, ["user_id"], [F.desc("score"), "start"], 2)


CV = f"""WITH {DAYS}, y AS (SELECT user_id, date, value AS y, CAST(date - DATE '2024-01-01' AS DOUBLE) AS t FROM x WHERE value IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM y)"""


@query(CV + """, r AS (SELECT *, CASE WHEN p < floor(n * 0.7) THEN 'train' ELSE 'test' END AS role FROM p),
f AS (SELECT user_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(y) AS m FROM r WHERE role = 'train' GROUP BY user_id)
SELECT user_id, round(1 - sum((y - coalesce(a + b * t, m)) ** 2) / nullif(var_pop(y) * count(*), 0), 4) AS r2_mean, round(sqrt(avg((y - coalesce(a + b * t, m)) ** 2)), 4) AS rmse_mean, 1::BIGINT AS folds FROM r JOIN f USING (user_id) WHERE role = 'test' GROUP BY user_id""")
def cv_time_series_uni(t: Tables) -> DataFrame:
    rows = _days(t).where("value is not null").withColumn("t", F.date_diff("date", F.lit("2024-01-01").cast("date")).cast("double"))
    out = series.cross_validated(series.folds(rows, ["user_id"], "date"), ["user_id"], "t", "value")
    return out.select("user_id", F.round("r2_mean", 4).alias("r2_mean"), F.round("rmse_mean", 4).alias("rmse_mean"), "folds")


@query(CV + """, r AS (SELECT user_id, date, k AS fold, CASE WHEN p < n - (4 - k) * (n // 4) THEN 'train' WHEN p < n - (3 - k) * (n // 4) THEN 'test' END AS role FROM p, (VALUES (1), (2), (3)) AS k(k) WHERE n > 8 AND n // 4 >= 4)
SELECT user_id, fold, role, count(*) AS n, min(date) AS start, max(date) AS stop FROM r WHERE role IS NOT NULL GROUP BY ALL
UNION ALL SELECT user_id, 1, role, count(*), min(date), max(date) FROM (SELECT *, CASE WHEN p < floor(n * 0.7) THEN 'train' ELSE 'test' END AS role FROM p WHERE n <= 8) GROUP BY ALL""")
def cv_folds_blocks(t: Tables) -> DataFrame:
    rows = series.folds(_days(t).where("value is not null"), ["user_id"], "date", k=3, least=4)
    return rows.groupBy("user_id", "fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("stop"))


@query("SELECT user_id, CAST(ts AS DATE) AS date, round(coalesce(avg(value) FILTER (event_type = 'click'), avg(value)), 6) AS value FROM events GROUP BY ALL")
def prefer_flagged_daily(t: Tables) -> DataFrame:
    return series.prefer_flagged(t.events.withColumn("date", F.to_date("ts")), ["user_id", "date"], "value", "event_type", "click").withColumn("value", F.round("value", 6))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_by_group(t: Tables) -> DataFrame:
    return joins.first_row(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY o_custkey) * 0.7) THEN 'train' ELSE 'test' END AS role FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def sequential_split(t: Tables) -> DataFrame:
    from soilspark.operators import split

    return split.sequential(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.3).select("o_custkey", "o_orderkey", "role")


@query("SELECT o_orderkey, CASE WHEN (o_custkey * 2654435761) % 1000 < 300 THEN 'test' ELSE 'train' END AS role FROM orders")
def grouped_split(t: Tables) -> DataFrame:
    from soilspark.operators import split

    return split.by_number(t.orders, F.col("o_custkey"), 0.3).select("o_orderkey", "role")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'Unknown' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'Train' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'Validation' ELSE 'Not in Set' END AS role FROM customer""")
def split_roles(t: Tables) -> DataFrame:
    from soilspark.operators import split

    ids = t.customer.select(F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey")).alias("k"), "c_custkey")
    train = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return split.roles(ids, "k", train, t.orders.select(F.col("o_custkey").alias("k"))).select("c_custkey", "role")
