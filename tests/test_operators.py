"""Operators on small tables with the cases that data brings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from soilspark.functions import clean, depth, geo, vg
from soilspark.operators import aggregates, joins, metrics, reshape, series, spatial, split
from soilspark.plans import assemble, compare, fit, forest, posterior, standardize, vector_forest
from soilspark.sources import files, sinks


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, -9999.0), (5, -99.99), (6, None)], "k int, v double")
    assert dict(values(clean.missing_to_null(df, ["v"], equal=(-99.99,)), "k", "v")) == {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_levels_by_range_and_by_sensor(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (10.0,), (45.0,), (250.0,), (400.0,), (-3.0,), (None,)], "cm double")
    assert values(df, depth.level(F.col("cm")), depth.sensor_level(F.col("cm"))) == [(1, None), (2, None), (3, 2), (5, 4), (7, None), (7, None), (1, None), (None, None)]


def test_curve_and_inverse_agree(spark):
    df = spark.createDataFrame([(100.0, 0.05, 0.45, 0.02, 1.5), (1e4, 0.02, 0.5, 0.5, 3.0)], "psi double, tr double, ts double, a double, n double")
    p = [F.col(c) for c in ("tr", "ts", "a", "n")]
    back = vg.psi(vg.theta(F.col("psi"), *p), *p, margin=0.0)
    for got, want in values(df, back, "psi"):
        assert got == pytest.approx(want, rel=1e-3)
    assert values(df.limit(1), vg.theta(F.col("psi"), p[0], p[1], p[2], F.lit(1.0))) == [(None,)]


def test_texture_sums_to_a_hundred(spark):
    df = spark.createDataFrame([(33.3, 33.3, 33.3), (1.0, 1.0, 5.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = values(df, *geo.texture_percent(F.col("a"), F.col("b"), F.col("c")))
    assert [sum(r) for r in got[:2]] == [100, 100]
    assert got[2] == got[3] == (None, None, None)


def test_many_to_one_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        joins.many_to_one(left, right, ["k"])


def test_nearest_centre(spark):
    centres = spark.createDataFrame([(1, 0.0, "a"), (2, 10.0, "b")], "level int, centre double, name string")
    df = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.1), (4, None), (4, None)], "id int, v double")
    assert values(joins.nearest_join(df, centres, F.col("v"), "centre", "level").orderBy("id"), "id", "level", "name") == [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, None, None), (4, None, None)]


def test_polygons_both_ways(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0), (3, 1.5, 0.5)], "id int, x double, y double")
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    tiles = spark.createDataFrame([("a", ring)], "tile string, ring array<struct<x:double,y:double>>")
    assert values(spatial.within(points, tiles, "x", "y"), "id", "tile") == [(1, "a")]
    assert values(spatial.within(points, tiles, "x", "y", max_broadcast=0), "id", "tile") == [(1, "a")]


def test_first_known_skips_null(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "a", None), (2, 1, None, None)], "k int, o int, a string, b string")
    assert sorted(values(aggregates.first_known(df, ["k"], ["a", "b"], "o"), "k", "a", "b", "n")) == [(1, "a", "x", 2), (2, None, None, 1)]


def test_metrics_of_constant_observations(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5), (None, 1.0), (1.0, None)], "y double, p double")
    r = df.agg(*metrics.regression_metrics(F.col("y"), F.col("p"))).first()
    assert (r["n"], r["r2"], r["bias"], r["rmse"]) == (2, None, 0.0, 0.5)


def test_named_columns_need_enough_values(spark):
    df = spark.createDataFrame([(1, 0.1, 0.5, None)], "id int, US_L1_VG_a double, US_L1_VG_b double, US_L2_VG_a double")
    got = reshape.named_columns(df, ["id"], r"US_L(\d)_VG_(.+)", ["level", "param"], "param", ["a", "b"], least=2)
    assert values(got, "id", "level", "a", "b") == [(1, "1", 0.1, 0.5)]


def test_daily_spine(spark):
    df = spark.createDataFrame([("s", "2024-01-01 05:00:00", 1.0), ("s", "2024-01-04 05:00:00", 3.0), ("s", "2024-01-04 06:00:00", 5.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    assert [r[2] for r in values(series.daily(df, ["k"], "t", "v").orderBy("date"), "k", "date", "v")] == [1.0, None, None, 4.0]
    assert [r[2] for r in values(series.daily(df, ["k"], "t", "v", how="sum").orderBy("date"), "k", "date", "v")] == [1.0, 0.0, 0.0, 8.0]


def test_folds_of_long_series(spark):
    df = spark.range(200).select(F.lit("s").alias("k"), F.col("id").alias("t"))
    got = series.folds(df, ["k"], "t").where("role = 'test'").groupBy("fold").agg(F.min("t"), F.max("t")).orderBy("fold")
    assert [tuple(r) for r in got.collect()] == [(1, 35, 67), (2, 68, 100), (3, 101, 133), (4, 134, 166), (5, 167, 199)]
    for n, train in ((59, 41), (60, 42), (61, 0)):  # 61: blocks of 10 rows are too short
        rows = series.folds(df.where(F.col("t") < n), ["k"], "t")
        assert rows.where("role = 'train'").count() == train


def test_fit_recovers_a_curve_and_reports_failure(spark):
    rows = [("a", 10.0, float(h), 0.05 + 0.4 / (1 + (0.02 * h) ** 1.6) ** (1 - 1 / 1.6)) for h in (1, 10, 30, 100, 300, 1000, 5000, 15000)] + [("b", 10.0, 1.0, 0.4)] * 3
    obs = spark.createDataFrame(rows, "profile_id string, depth_cm double, suction_cm double, theta double")
    got = {r["profile_id"]: r for r in fit.fits(obs, ["profile_id", "depth_cm"]).collect()}
    assert got["b"]["status"] == "Failed" and got["b"]["alpha"] is None
    assert got["a"]["alpha"] == pytest.approx(0.02, rel=0.02) and got["a"]["n"] == pytest.approx(1.6, rel=0.02) and got["a"]["n_obs"] == 8
    inverse = fit.fits(obs.where("profile_id = 'a'"), ["profile_id", "depth_cm"], inverse=True).first()
    assert inverse["alpha"] == pytest.approx(0.02, rel=0.05)
    methods = fit.compared(fit.fits(obs, ["profile_id", "depth_cm"], list(fit.METHODS)), ["profile_id", "depth_cm"])
    assert methods.count() == len(fit.METHODS)
    p = {r["param"]: r for r in posterior.posterior(obs, ["profile_id", "depth_cm"], draws=600, tune=400).collect()}
    assert p["n"]["q025"] < 1.6 < p["n"]["q975"]


def test_standardised_network(spark):
    raw = spark.createDataFrame([("a/b", -10.0, 25.0, 5.0)] * 4 + [("c", -1.0, 20.0, 5.0)] * 3 + [("a/b", None, 20.0, 5.0)], "id string, kpa double, vwc double, d double")
    out = standardize.network(raw, "id", "d", "kpa", "kPa", "vwc", percent=True, least=4)
    assert values(out.distinct(), "profile_id", "theta") == [("a_b", 0.25)]
    with pytest.raises(ValueError):
        standardize.one_site(raw, "id")
    curves = standardize.paired_curves(spark.createDataFrame([(1, -10.0, 0.3, None, 0.2)], "i int, h1 double, t1 double, h2 double, t2 double"), ["i"])
    assert values(curves, "suction_cm", "theta") == [(10.0, 0.3)]


def test_registry_and_features(spark):
    assert assemble.source("gshp").fitted is False
    with pytest.raises(KeyError):
        assemble.source("nowhere")
    assert [s.name for s in assemble.requiring_fits()] == ["ncss", "mt_mesonet", "reesh"]
    names = assemble.feature_names(["theta_r", "id", "A00", "clay_mean", "depth_cm", "B5"], ["theta_r"], ["id"], depth="none", prefixes=("clay",))
    assert names == ["A00", "B5"]
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(values(assemble.encoded(df, ["c"]), "c"), key=str) == [(1,), (2,), (None,)]


def test_rounding_goes_to_the_largest_rounded_part(spark):
    df = spark.createDataFrame([(33.4, 33.45, 33.15), (10.4, 44.8, 44.8)], "a double, b double, c double")
    assert values(df, *geo.texture_percent(F.col("a"), F.col("b"), F.col("c"))) == [(34, 33, 33), (10, 45, 45)]


def test_forests_keep_all_rows(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 4 != 0, F.col("id") % 5).cast("double").alias("w"), (F.col("id") % 10 * 2).cast("double").alias("y"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") % 2 + 1).cast("int").alias("level"))
    models = forest.trained_targets(df, ["y", "z"], ["x", "w"], trees=3, depth=3)
    got = forest.inferred_targets(models, df)
    assert got.count() == 120 and got.where("y_pred is null").count() == got.where("w is null").count() == got.where("z_pred is null").count() == 30
    levels = forest.trained_levels(df, "level", [1, 2, 3], ["y", "z"], ["x"], trees=3, depth=3)
    assert sorted(levels) == [(1, "y"), (1, "z"), (2, "y"), (2, "z")]
    by_level = forest.inferred_levels(levels, df.withColumn("level", F.when(F.col("x") == 9, 3).otherwise(F.col("level"))), "level")
    assert by_level.count() == 120 and by_level.where("y_pred is null").count() == 12
    assert by_level.where("level = 1 and abs(y - y_pred) > 1e-6").count() == 0
    forest.saved(models, str(tmp_path / "m"))
    back = forest.loaded(spark, str(tmp_path / "m"))
    assert sorted(back) == ["y", "z"] and values(forest.inferred_targets(back, df).orderBy("x", "w"), "y_pred") == values(got.orderBy("x", "w"), "y_pred")


def plain_battery(days, lags, n_splits=5, min_test=30):
    """One site's battery by loops: ``days`` are dicts in order, with theta, psi, y, p, q and drydown."""
    import numpy as np

    def scored(rows):
        n = len(rows)
        if n <= 2 * min_test:
            folds = [(range(int(n * 0.7)), range(int(n * 0.7), n))]
        else:
            size = n // (n_splits + 1)
            starts = range(n - n_splits * size, n, size)
            folds = [(range(s), range(s, s + size)) for s in starts if size >= min_test]
        r2, rmse = [], []
        for train, test in folds:
            if len(train) < 2 or not len(test):
                continue
            x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            a = np.column_stack([np.ones(len(train)), x[list(train)]])
            beta = np.linalg.lstsq(a, y[list(train)], rcond=None)[0]
            err = y[list(test)] - np.column_stack([np.ones(len(test)), x[list(test)]]) @ beta
            spread = ((y[list(test)] - y[list(test)].mean()) ** 2).sum()
            r2.append(1 - (err**2).sum() / spread)
            rmse.append((err**2).mean() ** 0.5)
        return (np.mean(r2), np.mean(rmse), len(rmse)) if rmse else None

    out = {}
    for name in ("theta", "psi"):
        for scope in ("all", "drydown"):
            use = [i for i, d in enumerate(days) if scope == "all" or d["drydown"]]
            known = lambda *v: all(x is not None for x in v)
            rows = lambda lag, cov: [([days[i - lag][name], *[days[i][c] for c in cov]], days[i]["y"]) for i in use if i >= lag and known(days[i - lag][name], days[i]["y"], *[days[i][c] for c in cov], *([] if cov else [days[i]["theta"]]))]  # noqa: B023, E731
            out[name, "uni", scope] = (0, scored(rows(0, [])))
            out[name, "mv", scope] = (0, scored(rows(0, ["p", "q"])))
            each = [(k, s) for k in lags if (s := scored(rows(k, ["p", "q"])))]
            out[name, "lagged", scope] = max(each, key=lambda e: (e[1][0], -e[0])) if each else (0, None)
    return {k: v for k, v in out.items() if v[1]}


def test_battery_equals_plain_loops(spark):
    import math
    import random

    from soilspark.operators import series
    from soilspark.plans import battery

    rng = random.Random(4)
    rows = []
    for site, n in (("a", 70), ("b", 210)):
        for k in range(n):
            theta = 0.3 + 0.1 * math.sin(k / 9) + 0.02 * rng.random()
            rows.append((site, k, None if rng.random() < 0.05 else theta, None if rng.random() < 0.05 else 1 / theta, 2 * theta + 0.01 * k + rng.random() * 0.1, math.cos(k / 20), None if rng.random() < 0.03 else rng.random()))
    df = spark.createDataFrame(rows, "site string, day int, theta double, psi double, y double, p double, q double")
    got = {}
    for r in battery.battery(df, ["site"], "day", ["y"], "theta", ["psi"], ["p", "q"]).collect():
        got.setdefault(r["site"], {})[r["replicate"], r["model"], r["scope"]] = (r["lag"], (r["r2_mean"], r["rmse_mean"], r["folds"]))
    for site in ("a", "b"):
        days = [r.asDict() for r in series.drydown(df.where(F.col("site") == site), ["site"], "day", "theta").orderBy("day").collect()]
        want = plain_battery(days, battery.LAGS)
        assert set(got[site]) == set(want) and any(k[2] == "drydown" for k in want)
        for k, (lag, values_) in want.items():
            assert got[site][k][0] == lag and got[site][k][1] == pytest.approx(values_, rel=1e-6)


def test_posteriors_stay_within_series_bounds(spark):
    days = spark.createDataFrame([("a", 0.11), ("a", 0.41), ("b", 0.2), ("b", 0.648)], "k string, theta double")
    bounds = posterior.series_bounds(days, ["k"])
    got = {r["k"]: r for r in bounds.collect()}
    assert got["a"]["theta_r_cap"] == pytest.approx(0.10999) and got["a"]["theta_s_floor"] == 0.41 and got["a"]["theta_s_upper"] == 0.65
    assert got["b"]["theta_s_upper"] == pytest.approx(0.65) or got["b"]["theta_s_upper"] == pytest.approx(0.668)
    psi = [1.0, 10.0, 100.0, 1000.0, 15000.0]
    curve = lambda x: 0.15 + 0.2 * (1 + (0.02 * x) ** 1.4) ** -(1 - 1 / 1.4)
    obs = spark.createDataFrame([(k, x, curve(x)) for k in ("a", "c") for x in psi], "k string, suction_cm double, theta double")
    post = {(r["k"], r["param"]): r for r in posterior.posterior(obs, ["k"], draws=400, tune=400, bounds=bounds).collect()}
    assert post["a", "theta_r"]["q975"] <= 0.11 and post["a", "theta_s"]["q025"] >= 0.41 and post["a", "theta_s"]["q975"] <= 0.65
    assert post["c", "theta_s"]["q025"] >= 0.45 and post["c", "theta_r"]["q975"] <= 0.05  # nothing known: the prior's own bounds


def test_weighted_inverse_fit_finds_the_curve(spark):
    psi = [2.0, 10.0, 60.0, 330.0, 1000.0, 5000.0, 15000.0]
    curve = lambda x: 0.06 + 0.38 * (1 + (0.03 * x) ** 1.5) ** -(1 - 1 / 1.5)
    obs = spark.createDataFrame([("a", x, curve(x)) for x in psi], "k string, suction_cm double, theta double")
    r = fit.fits(obs, ["k"], inverse="weighted").first()
    assert r["status"] == "Success" and r["alpha"] == pytest.approx(0.03, rel=0.05) and r["n"] == pytest.approx(1.5, rel=0.02)


def test_seeded_shuffle(spark):
    df = spark.range(50)
    one = [r[0] for r in split.shuffled(df.repartition(3), ["id"]).collect()]
    assert one == [r[0] for r in split.shuffled(df, ["id"]).collect()] != list(range(50)) and sorted(one) == list(range(50))


def test_states_merge_in_any_order(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 4.0), ("b", None, None), ("a", 6.0, 2.0)], "k string, v double, w double").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    part = lambda k: sinks.daily_state(df.where(F.col("n") == k), ["k"], ["v", "w"])
    one = sinks.merged_state(sinks.merged_state(part(0), part(1), ["k"]), sinks.merged_state(part(3), part(2), ["k"]), ["k"])
    two = sinks.merged_state(part(2), sinks.merged_state(part(3), sinks.merged_state(part(1), part(0), ["k"]), ["k"]), ["k"])
    assert sorted(values(sinks.state_means(one, ["k"]), "k", "v", "w")) == sorted(values(sinks.state_means(two, ["k"]), "k", "v", "w")) == [("a", 3.0, 3.0), ("b", None, None)]


def test_categories_are_bounded_and_comparisons_are_not(spark, monkeypatch):
    monkeypatch.setattr(assemble, "MAX_CODES", 3)
    df = spark.range(4).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        assemble.category_codes(df, "c")
    got = files.for_ids(df.withColumnRenamed("c", "id"), spark.createDataFrame([("p", "zz"), ("q", "y3y"), ("r", "x3")], "path string, name string"), "id")
    assert sorted(map(tuple, got.collect())) == [("0", None), ("1", None), ("2", None), ("3", "r")]


def test_forest_checks_its_features(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 * 2).cast("double").alias("y"))
    model = forest.trained(df, "y", ["x"], trees=5, depth=4)
    assert forest.scored(forest.inferred(model, df), ["y"]).first()["r2"] > 0.9
    with pytest.raises(ValueError):
        forest.inferred(model, df.drop("x"))
    filled = forest.imputed(spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "v double, c string"), df.sparkSession.createDataFrame([(1.0, "a"), (3.0, "b"), (2.0, "a")], "v double, c string"), ["v"], ["c"])
    assert (2.0, "a") in values(filled, "v", "c")


def test_roles(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    got = split.roles(ids, "k", spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int"))
    assert sorted(values(got, "k", "role"), key=str) == [(1, "Train"), (2, "Validation"), (3, "Not in Set"), (None, "Unknown")]


def test_influence_has_a_curve_for_each_statistic(spark):
    df = spark.createDataFrame([(0.05, 0.4, 0.01, 1.5), (0.03, 0.5, 0.1, 2.0)], "theta_r double, theta_s double, alpha double, n double")
    out = compare.influence(df, "alpha", points=10)
    assert out.count() == 40 and out.where("theta is null").count() == 0


# --- files -------------------------------------------------------------------------------------------------------------------------------


def test_fit_documents(spark, tmp_path):
    fitted = lambda tr: {"status": "Success", "n_obs": 4, "aic": -1.0, "parameters": {"theta_r": {"value": tr, "stderr": 0.1}, "alpha": {"value": 0.02}}, "data": {"theta": [0.1, 0.2], "suction_cm": [1.0, 2.0]}}
    doc = {"10": fitted(0.05), "10.5": {**fitted(0.06), "data": None}, "deep": fitted(0.07), "20": {**fitted(0.08), "status": "Failed"}, "metadata": {"10": {"profile_id": "p1"}}}
    (tmp_path / "stem.json").write_text(json.dumps(doc))
    got = sorted(values(files.fit_documents(spark, str(tmp_path)), "profile_id", "depth_cm", "theta_r", "n", "data_ct"))
    assert got == [("p1", 10.0, 0.05, None, 2), ("stem", 10.5, 0.06, None, -9999)]


def test_file_dispatch_and_concatenation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,w\n2,3\n")
    (tmp_path / "c.csv").write_text("uid,w\n2,3\n")
    (tmp_path / "d.csv").write_text("k,v\n")
    paths = [str(tmp_path / f"{c}.csv") for c in "abcd"]
    assert sorted(values(files.concatenated(spark, paths), "k", "v", "w")) == [(1, 2, None), (2, None, 3)]
    assert files.table(spark, paths[0]).count() == 1
    with pytest.raises(ValueError):
        files.table(spark, "x.xlsx")
    assert values(files.keyed_by_name(files.table(spark, paths[0]), "site"), "k", "site") == [(1, "a")]


def test_half_hourly(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# a\n# b\nTIMESTAMP_START,TIMESTAMP_END,SWC_1,LE\n202401010000,202401010030,31.5,-9999\n202401010030,202401010100,0,12\n")
    out = files.half_hourly(spark, str(tmp_path / "t.csv"), "us-x")
    assert values(out, "SWC_1", "LE") == [(31.5, None), (None, 12.0)]
    assert files.family(out, "SWC") == ["SWC_1"]


def test_discovery(spark, tmp_path):
    for n in ("s1.parquet", "s2_x.parquet", "AMF_US-Abc_BASE_HH.parquet", "m_val_r2=0.21.parquet", "m_val_r2=0.22.parquet"):
        (tmp_path / n).write_text("x")
    found = files.candidates(spark, str(tmp_path), "*.parquet")
    ids = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "id string")
    got = {r["id"]: r["path"] and r["path"].rpartition("/")[2] for r in files.for_ids(ids, found, "id").collect()}
    assert got == {"s1": "s1.parquet", "s2": "s2_x.parquet", "s9": None}
    assert files.best_checkpoint(found, "val_r2").first()["score"] == 0.22
    assert ("us-abc",) in values(found, files.tower_site(F.col("name")))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    sinks.by_group(df, "k", str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2
    fits = spark.createDataFrame([("p", 10.0, "Success", 5, *[0.1] * 13)], "id string, depth_cm double, status string, n_obs int, theta_r double, theta_s double, alpha double, n double, theta_r_stderr double, theta_s_stderr double, alpha_stderr double, n_stderr double, chi_squared double, reduced_chi_squared double, aic double, bic double, x double")
    sinks.fit_documents(fits, "id", str(tmp_path / "f"))
    back = files.fit_documents(spark, str(tmp_path / "f" / "id=p"))
    assert values(back, "depth_cm", "alpha") == [(10.0, 0.1)]
    assert json.loads(sinks.geojson(spark.createDataFrame([(1.0, 2.0, "n")], "x double, y double, name string"), "x", "y").first()[0])["geometry"]["coordinates"] == [1.0, 2.0]
    assert values(sinks.merged_daily(df, df.withColumn("v", F.col("v") + 2), ["k"], "v").orderBy("k"), "k", "v") == [("a", 2.0), ("b", 3.0)]
    assert values(sinks.missing_only(df, df.where("k = 'a'"), ["k"]), "k") == [("b",)]


def test_daily_stream(spark, tmp_path):
    from soilspark.streaming import daily as stream

    spark.createDataFrame([("s", "2024-01-01 01:00:00", 1.0), ("s", "2024-01-01 02:00:00", 3.0), ("s", "2024-01-09 02:00:00", 5.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = stream.started(stream.daily(source, ["k"], "t", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.schema("k string, date date, v double, n long").parquet(str(tmp_path / "out"))
    assert [(str(r[0]), r[1]) for r in values(got, "date", "v")][:1] == [("2024-01-01", 2.0)]


# --- sites and composites ------------------------------------------------------------------------------------------------------------------


def test_tower_days(spark):
    from soilspark.plans import site

    rows = [("s", f"2024-01-0{d} 00:{m:02d}:00", 30.0 + d, 100.0 if d < 3 else None, 2.0) for d in (1, 2, 3) for m in (0, 30)]
    df = spark.createDataFrame(rows, "site_id string, ts string, SWC_1 double, LE_F double, GPP double").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r["date"]): r for r in site.tower_days(df).collect()}
    assert sorted(got) == ["2024-01-01", "2024-01-02"]  # no evaporation is known of the third day
    assert got["2024-01-01"]["theta"] == pytest.approx(0.31) and got["2024-01-01"]["ET"] == pytest.approx(2 * 100 * 1800 / 2.45e6)
    none = site.tower_days(df.drop("SWC_1", "LE_F"))
    assert none.count() == 3 and none.where("theta is not null").count() == 0
    params = spark.createDataFrame([("s", 0.05, 0.45, 0.02, 1.5)], "site_id string, theta_r double, theta_s double, alpha double, n double")
    assert site.with_suction(site.tower_days(df), params).where("psi_cm > 0").count() == 2


def test_network_days(spark):
    from soilspark.plans import site

    rows = [("n", "a", 45.0, None, 0.05, 0.05, "2024-01-01 01:00:00", 0.2, "G"), ("n", "a", 45.0, None, 0.05, 0.05, "2024-01-01 02:00:00", 0.9, "D01"), ("n", "a", None, -110.0, 0.1, None, "2024-01-02 01:00:00", 0.3, "D01")]
    df = spark.createDataFrame(rows, "network string, station string, latitude double, longitude double, depth_from double, depth_to double, date_time string, soil_moisture double, soil_moisture_flag string").withColumn("date_time", F.to_timestamp("date_time"))
    days = site.network_days(df)
    assert sorted(values(days, "depth_cm", "theta")) == [(5, 0.2), (10, 0.3)]
    assert values(site.station_table(df), "station", "latitude", "longitude", "depths") == [("a", 45.0, -110.0, 2)]
    assert "soil_vwc_0005" in site.wide_days(days, [5, 10]).columns


def test_overlapping_periods(spark):
    from soilspark.operators import composites

    df = spark.createDataFrame([("s", "2024-05-01", 1.0), ("s", "2024-12-31", 3.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    out = composites.composite(df, ["k"], ["v"], "d").first()
    assert out["v_mean_1"] == out["v_mean_gs"] == 1.0 and out["v_mean_0"] == 3.0 and out["v_mean_2"] is None


def test_masks_hide_the_share(spark):
    from soilspark.operators import composites

    df = spark.range(50)
    for kind, exact in (("patch", True), ("end", True), ("speckled", False), ("mixed", False)):
        n = [r[0] for r in df.select(F.size(F.filter(composites.masked_positions(40, 0.25, kind, F.col("id")), lambda x: x))).collect()]
        assert set(n) == {10} if exact else 5 < sum(n) / 50 < 15


def test_feature_families(spark):
    from soilspark.plans import features

    assert [features.family(c) for c in ("e07", "A63", "B5_mean_gs", "clay_0-5cm_mean", "xyz")] == ["embedding", "embedding", "landsat", "soil", "other"]
    assert features.without(["e00", "lat", "xyz"], ("embedding", "location")) == ["xyz"]
    shown = {
        "nd_stdDev_3": "NDVI std dev (Q3)", "B10_mean_gs": "Landsat B10 (thermal) mean (growing season)", "tmmn_mean_winter": "gridMET tmin mean (winter)", "VH_VV_stdDev": "Sentinel-1 VH_VV std dev",
        "vegetation_water_content_pm_mean": "SMAP L3 VWC (PM) mean", "sm_rootzone_mean": "SMAP L4 Rootzone soil moisture mean", "soc_15-30cm_sd": "SoilGrids SOC std dev (15-30cm)", "wc_tmin_spring": "WorldClim tmin (spring)",
        "eto_summer": "Global ET0 (summer)", "eto_yearly_sd": "Global ET0 yearly (std dev)", "clay_mean": "SoilGrids clay (mean)", "n_mean": "POLARIS van Genuchten n (mean)", "hhs_wcsat_M_50": "HiHydroSoil v2 wcsat M 50",
        "cdl_simple_crop_mode": "CDL simple crop (mode)", "ssurgo_awc": "SSURGO awc", "tdmean": "PRISM normals 1991\u20132020 dewpoint mean", "A07": "AlphaEarth Foundations Satellite Embedding 7",
        "e00": "Site embedding 0", "embedding_12": "Google Satellite Embedding 12", "lat": "Latitude", "odd": "odd", "tpi_10000": "Topographic position index (10 km)",
    }
    df = spark.createDataFrame([(c,) for c in [*shown, None]], "c string")
    assert dict(values(df, "c", features.label(F.col("c")))) == shown | {None: None}


def brute_chi(psi, theta):
    """The least sum of squares over a dense grid of alpha and n; the best contents of each are linear, and held to the bounds of the fit."""
    import numpy as np

    least = np.inf
    for n in np.linspace(1.05, 3.0, 118):
        for a in np.geomspace(0.003, 0.12, 120):
            se = (1 + (a * psi) ** n) ** -(1 - 1 / n)
            (tr, ts), *_ = np.linalg.lstsq(np.stack([1 - se, se], axis=1), theta, rcond=None)
            if 0 <= tr <= 1.1 * theta.min() and 0.9 * theta.max() <= ts <= 1.1 * theta.max():
                least = min(least, float(((tr + (ts - tr) * se - theta) ** 2).sum()))
    return least


@pytest.fixture
def few_parts(spark, tmp_path):
    from soilspark.plans.catalog import Tables

    spark.createDataFrame([(k, 1 + 7 * k % 50) for k in range(1, 13)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return Tables(spark, str(tmp_path))


def test_every_part_is_fitted_as_well_as_by_brute_force(few_parts):
    import numpy as np

    from soilspark.plans import q_models

    points = {}
    for r in q_models.curves(few_parts).collect():
        points.setdefault(r["p_partkey"], []).append((r["suction_cm"], r["theta"]))
    for run in (q_models.vg_fit_grouped, q_models.inverse_fit):
        got = {r["p_partkey"]: r for r in run(few_parts).collect()}
        assert sorted(got) == list(range(1, 13)) and all(r["status"] == "Success" and r["n_obs"] == 12 for r in got.values())
        if run is q_models.vg_fit_grouped:
            for k, r in got.items():
                assert r["chi_squared"] <= 1.001 * brute_chi(*np.array(sorted(points[k])).T)


def test_every_part_is_compared_and_has_a_posterior_of_full_length(few_parts):
    from soilspark.plans import q_models

    compared = values(q_models.fit_method_compare(few_parts), "p_partkey", "method")
    assert sorted(compared) == sorted((k, m) for k in range(1, 13) for m in fit.METHODS)
    want = {(r["p_partkey"], r["param"]): r["mean"] for r in posterior.posterior(q_models.curves(few_parts), ["p_partkey", "depth_cm"], draws=2000, tune=1000).collect()}
    got = {(r["p_partkey"], r["param"]): r["mean"] for r in q_models.posterior_fit(few_parts).collect()}
    assert len(got) == 48 and got == want


def test_registered_forests_are_of_full_size(spark, monkeypatch):
    from soilspark.plans import q_models
    from soilspark.plans.catalog import Tables

    sizes, grow = [], vector_forest.grown

    def spied(*args, **more):
        model = grow(*args, **more)
        sizes.append(model.feature.shape)
        return model

    monkeypatch.setattr(vector_forest, "grown", spied)
    t = Tables(spark, "/root/testdata/sf0.001")
    assert q_models.rf_train_metrics(t).count() == 1 and q_models.rf_importance(t).count() == 3
    assert sizes == [(250, (2 << 8) - 1)] * 2


def test_repeated_cells_do_not_meet_their_points(spark):
    from soilspark.operators import composites

    cells = spark.createDataFrame([(0.0, 0.0, n, n * 1.5) for n in range(5, 0, -1)] + [(10.0, 0.0, 9, 7.0), (10.0, 0.0, None, 8.0)], "x double, y double, n int, v double")
    points = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 1.0), (3, 11.0, 0.0), (4, 90.0, 0.0)], "k int, px double, py double")
    out = composites.cell_series(cells, points, "px", "py", 10.0, ["k"], ["n"])
    assert sorted(values(out, "k", "v")) == [(1, 1.5), (2, 1.5), (3, 8.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.find("Aggregate") > plan.find("Join") > 0
    times = cells.withColumn("t", F.col("n") % 2).where("n is not null")
    out = composites.cell_series(times, points, "px", "py", 10.0, ["k", "t"], ["n"])
    assert sorted(values(out, "k", "t", "v")) == [(1, 0, 3.0), (1, 1, 1.5), (2, 0, 3.0), (2, 1, 1.5), (3, 1, 7.0)]


@pytest.mark.parametrize("temperature", [0.1, 0.001])
def test_contrastive_losses_store_no_pairs(spark, temperature):
    import numpy as np

    from soilspark.operators import vectors

    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(200, 6)).astype(np.float32), rng.integers(0, 4, 200)
    label[7] = 99  # alone
    df = spark.createDataFrame([(k % 2, k, x[k].tolist(), int(label[k])) for k in range(200)], "b int, k long, v array<float>, l int")
    got = vectors.contrastive(df, "b", "k", "v", "l", temperature, side=16)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    for r in got.collect():
        at = np.arange(200) % 2 == r["b"]
        s, kin = u[at] @ u[at].T / temperature, label[at][:, None] == label[at][None, :]
        np.fill_diagonal(s, -np.inf)
        weight = lambda t: np.log(np.exp(t - t.max(axis=1, keepdims=True)).sum(axis=1)) + t.max(axis=1)
        some = (kin.sum(axis=1) > 1).nonzero()[0]
        assert r["n"] == len(some) and r["loss"] == pytest.approx((weight(s[some]) - weight(np.where(kin, s, -np.inf)[some])).mean())
    met = vectors.contrastive(df, "b", "k", "v", "l", temperature, side=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in met.lower() and "Generate" not in met  # vectors are not copied for each block that they meet


def test_kernel_densities_whose_rows_come_in_another_order_each_time(spark):
    """Deviations differ in their last digits with the order of rows; the places of a group stay one row each."""
    import numpy as np

    def shuffled(batches):
        rng = np.random.default_rng()
        for batch in batches:
            yield batch.iloc[rng.permutation(len(batch))]

    values_of = [[g, float(v)] for g in range(8) for v in np.random.default_rng(g).normal(size=400)]
    df = spark.createDataFrame(values_of, "g int, v double").repartition(4).mapInPandas(shuffled, "g int, v double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = aggregates.kernel_density(df, ["g"], "v", points=20).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r["g"], r["i"]) for r in got) == [(g, i) for g in range(8) for i in range(20)]
    v = np.array(values_of).reshape(8, 400, 2)[..., 1]
    h = v.std(axis=1, ddof=1) * 400**-0.2
    for r in got:
        a, k = v[r["g"]], h[r["g"]]
        x = a.min() - 3 * k + r["i"] * (a.max() - a.min() + 6 * k) / 19
        assert r["density"] == pytest.approx(np.exp(-(((x - a) / k) ** 2) / 2).sum() / (400 * k * np.sqrt(2 * np.pi)), rel=1e-3, abs=1e-4)


def test_a_flat_stretch_does_not_fall_however_its_rows_are_dealt(spark):
    """105.34, 12.66 and 25.73 have the mean 47.91, or one of a last digit more where the first comes last; between equal days the slope is then 1.8e-15 or -3.6e-15."""
    rows = [(6, 11, 46.77), (6, 18, 2.57), (7, 3, 105.34), (7, 10, 12.66), (7, 15, 25.73), (8, 16, 27.75), (8, 18, 21.59), (9, 1, 90.0), (10, 1, 95.0)]
    schema, masks, means = "k int, t timestamp, v double", [], []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        data = ", ".join(f"(1, TIMESTAMP '2024-01-{d:02} {h:02}:00:00', {v}D)" for d, h, v in order)
        df = spark.sql(f"SELECT * FROM VALUES {data} AS x(k, t, v)").to(spark.createDataFrame([], schema).schema).coalesce(1)
        days = series.daily(df, ["k"], "t", "v", how="ordered")
        means.append(values(days, "date", "v"))
        masks.append(values(series.drydown(days, ["k"], "date", "v", below=0.6, least=1), "date", "drydown"))
    assert means[0] == means[1] == means[2] and masks[0] == masks[1] == masks[2]
    assert [m for _, m in sorted(masks[0])] == [False, False, False, False, False]
    assert sorted(means[0])[1][1] == (105.34 + 12.66 + 25.73) / 3
    empty = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 05:00:00' AS t, CAST(NULL AS DOUBLE) AS v UNION ALL SELECT 1, TIMESTAMP '2024-01-03 05:00:00', 4D")
    assert [v for _, v in sorted(values(series.daily(empty, ["k"], "t", "v", how="ordered"), "date", "v"))] == [None, None, 4.0]


def test_masks_of_files_cut_within_a_day(spark, tmp_path):
    """The same rows in one file, and in two cut after the first observation of a day."""
    from soilspark.plans import q_models, q_series
    from soilspark.plans.catalog import Tables

    rows = [(6, 11, 46.77), (6, 18, 2.57), (7, 3, 105.34), (7, 10, 12.66), (7, 15, 25.73), (8, 16, 27.75), (8, 18, 21.59), (9, 1, 20.0), (10, 1, 95.0), (11, 1, 96.0)]
    data = ", ".join(f"(TIMESTAMP '2024-01-{d:02} {h:02}:00:00', 1L, {v}D)" for d, h, v in rows)
    df = spark.sql(f"SELECT * FROM VALUES {data} AS x(ts, user_id, value)")
    early = F.col("ts") < F.lit("2024-01-07 05:00:00").cast("timestamp")
    got = []
    for name, parts in (("one", [df.coalesce(1).sortWithinPartitions("ts")]), ("two", [df.where(~early).coalesce(1), df.where(early).coalesce(1)])):
        path = str(tmp_path / name)
        for part in parts:
            part.write.mode("append").parquet(f"{path}/events.parquet")
        t = Tables(spark, path)
        got.append((values(q_series.drydown_mask(t), "date", "drydown"), values(q_series.run_lengths(t), "start", "n"), values(q_models.site_battery(t), "model", "scope", "lag", "r2_mean")))
    assert sorted(got[0][0]) == sorted(got[1][0]) and got[0][1] == got[1][1] and len(got[0][1]) == 1
    assert not any(m for d, m in got[0][0] if d.day == 8)
