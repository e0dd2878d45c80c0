"""Stored states, files by name and their index."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from soilspark.sources import files, sinks, state

BY = ["k", "d"]


def batch(spark, rows):
    return sinks.daily_state(spark.createDataFrame(rows, "k string, d int, v double"), BY, ["v"])


def held(spark, root, number=None):
    return {(r["k"], r["d"]): (r["v_sum"], r["v_n"]) for r in state.read(spark, root, number).collect()}


def test_merges_add_up_and_old_versions_stay(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert state.merge(batch(spark, [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, None)]), root, BY, buckets=4) == 1
    assert state.merge(batch(spark, [("a", 1, 5.0), ("c", 9, 7.0), (None, 1, 4.0)]), root, BY, batch="x") == 2
    assert state.merge(batch(spark, [("a", 1, 5.0)]), root, BY, batch="x") == 2
    assert held(spark, root) == {("a", 1): (8.0, 3), ("b", 1): (0.0, 0), ("c", 9): (7.0, 1), (None, 1): (4.0, 1)}
    assert held(spark, root, 1) == {("a", 1): (3.0, 2), ("b", 1): (0.0, 0)}
    more = sinks.daily_state(spark.createDataFrame([("a", 1, 2.5)], "k string, d int, w double"), BY, ["w"])
    state.merge(more, root, BY)
    row = state.read(spark, root).where("k = 'a'").first()
    assert (row["v_sum"], row["w_sum"], row["w_n"]) == (8.0, 2.5, 1)
    assert state.cleared(spark, root) > 0 and state.versions(spark, root) == [3] and state.read(spark, root).where("k = 'c'").first()["v_sum"] == 7.0
    with pytest.raises(ValueError, match="by"):
        state.merge(more, root, ["k"])
    with pytest.raises(FileNotFoundError):
        state.read(spark, f"file://{tmp_path}/none")


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    state.merge(batch(spark, [("a", 0, 1.0)]), root, BY, buckets=2)
    both, place = threading.Barrier(2), state._placed
    waited = threading.local()

    def together(*args):
        if not getattr(waited, "once", False):  # both have written before either is in place
            waited.once = True
            both.wait(60)
        place(*args)

    monkeypatch.setattr(state, "_placed", together)
    faults = []

    def work(x):
        try:
            state.merge(batch(spark, [("a", 0, x), ("z", int(x), x)]), root, BY, batch=str(x))
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=work, args=(x,)) for x in (10.0, 100.0)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults and state.versions(spark, root) == [1, 2, 3]
    assert held(spark, root) == {("a", 0): (111.0, 3), ("z", 10): (10.0, 1), ("z", 100): (100.0, 1)}


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    state.merge(batch(spark, [("a", 0, 1.0)]), root, BY, batch="1", buckets=2)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(state, "_placed", crash)
        with pytest.raises(KeyboardInterrupt):
            state.merge(batch(spark, [("a", 0, 2.0)]), root, BY, batch="2")
    assert held(spark, root) == {("a", 0): (1.0, 1)} and state.version(spark, root).batches == ["1"]
    assert state.merge(batch(spark, [("a", 0, 2.0)]), root, BY, batch="2") == 2
    assert held(spark, root) == {("a", 0): (3.0, 2)} and state.cleared(spark, root) == 2


def test_a_version_is_put_in_place_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    state._placed(spark, root, state.Version(1, BY))
    with pytest.raises(state.Conflict):
        state._placed(spark, root, state.Version(1, ["other"]))
    assert state.version(spark, root).by == BY and len(list((tmp_path / "s" / "versions").glob("[0-9]*"))) == 1


def test_ids_are_found_in_names_as_by_comparing_all(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé_x1") for _ in range(n))
    names = sorted({word(rng.randint(1, 14)) for _ in range(300)})
    ids = {word(rng.randint(1, 7)) for _ in range(200)} | {"zzzz", "", "a"}
    want = {}
    for i in ids:
        fit = [(0, n) for n in names if n == i] or [(1, n) for n in names if n.startswith(i + "_")] or [(2, n) for n in names if i in n]
        want[i] = min(fit)[1] if fit else None
    found = spark.createDataFrame([(n, n) for n in names], "path string, name string")
    got = files.for_ids(spark.createDataFrame([(i,) for i in [*ids, "a", None]], "id string"), found, "id").collect()
    assert len(got) == len(ids) and {r["id"]: r["path"] for r in got} == want
    assert sum(1 for i, n in want.items() if n and not n.startswith(i)) > 30


def test_files_by_name(spark, tmp_path):
    rows = [("a b", 1), ("c/d", 2), ("é", 3), ("a b", 4)]
    sinks.named_files(spark.createDataFrame(rows, "name string, v int").repartition(3), "name", f"{tmp_path}/n")
    got = files.keyed_by_name(files.csv(spark, f"{tmp_path}/n", "v int"), "key").select("key", "v")
    assert sorted(map(tuple, got.collect())) == sorted((n.replace("/", "-"), v) for n, v in rows)
    assert got.where(F.col("v") == 3).first()["key"] == "é"


def test_named_files_are_moved_by_tasks(spark, tmp_path, monkeypatch):
    """The driver asks its file system for nothing a file, all keys get their files, and nothing of the job stays; a job that fails leaves no file."""
    import os

    from pyspark.sql import DataFrame

    rows = [(f"k{k}", v, f"{k} {v}") for k in range(300) for v in (2, 1, 3)] + [(None, 1, "x"), ("a/b", 1, "y"), ("a/b", 2, None)]
    df = spark.createDataFrame(rows, "name string, v int, line string").repartition(5)
    sent, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    sinks.named_lines(df, "name", "v", "line", f"{tmp_path}/l", "txt")
    assert sum(map(len, sent)) <= 16
    want = {f"k{k}.txt": f"{k} 1\n{k} 2\n{k} 3\n" for k in range(300)} | {f"{sinks.UNNAMED}.txt": "x\n", "a-b.txt": "y\n\n"}
    assert {x.name: x.read_text() for x in (tmp_path / "l").iterdir()} == want
    odd = spark.createDataFrame([("a", 'x,"y', None, ""), ("a", "é", 1.5, "z")], 'name string, `p,q` string, v double, w string')
    sinks.named_files(odd, "name", f"{tmp_path}/c")
    back = spark.read.option("header", True).schema("`p,q` string, v double, w string").csv(f"{tmp_path}/c/a.csv")
    odd.drop("name").write.option("header", True).csv(f"{tmp_path}/plain")
    plain = spark.read.option("header", True).schema(back.schema).csv(f"{tmp_path}/plain")
    assert back.columns == ["p,q", "v", "w"] and sorted(map(repr, back.collect())) == sorted(map(repr, plain.collect()))
    with pytest.raises(Exception, match="told to fail"):
        sinks.named_lines(df.withColumn("line", F.when(F.col("name") == "k7", F.raise_error(F.lit("told to fail"))).otherwise(F.col("line"))), "name", "v", "line", f"{tmp_path}/f")
    assert os.listdir(tmp_path / "f") == []


def test_shapefiles_round_trip_and_prune(spark, tmp_path, monkeypatch):
    from datetime import date

    from soilspark.sources import shapes

    ring = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    square = ring((0, 0), (0, 2), (2, 2), (2, 0), (0, 0))
    rows = [
        (1, "é ä", 0.1, date(2020, 2, 29), True, [square, ring((0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5))]), (2, None, None, None, None, None), (-(10**17), "x" * 254, -1.5e-300, date(1999, 1, 1), False, [ring((10, 10), (11, 12), (12, 10), (10, 10))]),
        *[(k, str(k), k / 7, None, None, [ring((k, k), (k, k + 1), (k + 1, k), (k, k))]) for k in range(20, 60)],
    ]
    schema = "id long, name string, v double, day date, ok boolean, rings array<array<struct<x: double, y: double>>>"
    path = f"file://{tmp_path}/s"
    shapes.write(spark.createDataFrame(rows, schema).repartition(3), path, fileRecords=9)
    back = shapes.read(spark, path, partitionRecords="4")
    got = back.select("id", "name", "v", "day", "ok", "rings").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, spark.createDataFrame(rows, schema).collect()))
    near = back.where("x0 >= 30 and y1 <= 41")
    assert sorted(r["id"] for r in near.collect()) == list(range(30, 41))
    assert back.where("x0 is null").count() == 1
    reader = shapes.ShapeReader({"path": path, "partitionrecords": "4"}, [])
    assert list(reader.pushFilters([shapes.GreaterThanOrEqual(("x0",), 30.0), shapes.EqualTo(("id",), 31)])) == [shapes.EqualTo(("id",), 31)]
    seen, whole = [], shapes.unpacked
    monkeypatch.setattr(shapes, "unpacked", lambda c: seen.append(1) or whole(c))
    parts = reader.partitions()
    assert len(parts) >= 11 and sum(p.count for p in parts) == len(rows)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 30 == len(seen)
    shapes.write(spark.createDataFrame([(7, [ring((3, 4))])], "id long, rings array<array<struct<x: double, y: double>>>"), f"{tmp_path}/p", kind=shapes.POINT)
    (point,) = shapes.read(spark, f"{tmp_path}/p").collect()
    assert (point["kind"], point["x0"], point["y1"], point["id"]) == (1, 3.0, 4.0, 7)
    with pytest.raises(Exception, match="at most 10"):
        shapes.write(spark.createDataFrame([(7, [square])], "a_very_long_name long, rings array<array<struct<x: double, y: double>>>"), f"{tmp_path}/q")


def test_archives_round_trip_and_open_only_what_is_wanted(spark, tmp_path, monkeypatch):
    from datetime import datetime, timezone

    from soilspark.sources import archives

    at = lambda m: datetime(2020, 1, 1, 0, m, tzinfo=timezone.utc)
    rows = [
        ("net", st, var, lo, lo + 0.1, "pro_be", 1.5, -2.25, 3.0, at(m), None if m == 2 else m / 7, "G" if m % 2 else None)
        for st in ("a", "b_c") for var in ("soil_moisture", "air_temperature") for lo in (0.0, 0.25) for m in range(4)
    ]
    df = spark.createDataFrame(rows, archives.SCHEMA)
    path = f"file://{tmp_path}/z"
    archives.write(df, path)
    back = archives.read(spark, path, partitionBytes="1")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    some = back.where("variable = 'soil_moisture' and depth_from > 0.1 and station like 'b%' and value > 0.2")
    assert sorted(r["value"] for r in some.collect()) == [3 / 7]
    reader = archives.ArchiveReader({"path": path, "partitionbytes": "1"})
    assert list(reader.pushFilters([archives.EqualTo(("variable",), "soil_moisture"), archives.GreaterThan(("value",), 0.2)])) == [archives.GreaterThan(("value",), 0.2)]
    parts = reader.partitions()
    assert len(parts) == 4 and all("soil_moisture" in name for p in parts for _, name in p.members)
    assert archives.told("readme.txt") is None and archives.told("n/s/n_x_v_0_1_p_1_2.stm") is None


def test_large_archives_are_dealt_by_ranges_and_small_members_share_batches(spark, tmp_path, monkeypatch):
    """The driver opens no archive then; each member is read by the one range that it begins in, and rows of many members are handed on at once."""
    import zipfile
    from datetime import datetime, timezone

    from soilspark.sources import archives

    rows = [("net", f"s{k:03d}", var, 0.0, 0.1, "p", 1.0, 2.0, 3.0, datetime(2020, 1, 1 + m, 5, tzinfo=timezone.utc), k + m / 7, None) for k in range(40) for var in ("a", "b") for m in range(2)]
    df = spark.createDataFrame(rows, archives.SCHEMA)
    path = f"file://{tmp_path}/z"
    archives.write(df.coalesce(1), path)
    reader = archives.ArchiveReader({"path": path, "partitionbytes": "700"})
    assert list(reader.pushFilters([archives.EqualTo(("variable",), "a")])) == []
    monkeypatch.setattr(archives, "LISTED_BYTES", 0)
    opened, whole = [], zipfile.ZipFile
    monkeypatch.setattr(archives.zipfile, "ZipFile", lambda *a, **k: opened.append(a) or whole(*a, **k))
    parts = reader.partitions()
    assert len(parts) > 3 and not opened and not any(p.members for p in parts)
    batches = [list(reader.read(p)) for p in parts]
    assert all(len(b) <= 1 for b in batches)
    got = sorted((r["station"], r["date_time"], r["value"]) for b in batches for x in b for r in x.to_pylist())
    assert got == sorted((r[1], r[9], r[10]) for r in rows if r[2] == "a")
    monkeypatch.setattr(archives, "PART_BYTES", 2000)
    monkeypatch.setattr(archives.zipfile, "ZipFile", whole)
    writer = archives.ArchiveWriter({"path": f"file://{tmp_path}/w"})
    (tmp_path / "w").mkdir()
    names = [c.split()[0] for c in archives.SCHEMA.split(", ")]
    done = writer.write(iter([archives.pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[:6])], schema=archives._ARROW)]))
    writer.commit([done])
    assert len(done.names) > 2 and archives.read(spark, f"file://{tmp_path}/w").count() == len(rows)


@pytest.mark.parametrize("most", [0, 100])
def test_rasters_are_sampled_and_only_blocks_with_points_are_read(spark, tmp_path, monkeypatch, most):
    import numpy as np

    from soilspark.sources import rasters

    rng = np.random.default_rng(1)
    values = rng.normal(size=(70, 50)).round(3)
    values[5, 7] = np.nan
    path, grid = f"file://{tmp_path}/r", rasters.Grid(-10.0, 20.0, 0.5, 0.25)
    pixels = [(i, j, None if np.isnan(v) else float(v)) for i, row in enumerate(values) for j, v in enumerate(row) if (i, j) != (60, 40)]
    rasters.write(spark.createDataFrame(pixels, "row int, col int, value double").repartition(3), path, grid, side=32, tile=16)
    back = {(r["row"], r["col"]): r["value"] for r in rasters.rows_of(rasters.read(spark, path, partitionBlocks="3")).where("value is not null").collect()}
    assert back == {(i, j): v for i, j, v in pixels if v is not None}
    points = [(k, -10 + (j + 0.5) * 0.5, 20 - (i + 0.5) * 0.25, (i, j)) for k, (i, j) in enumerate([(0, 0), (69, 49), (31, 32), (5, 7), (60, 40), (33, 1)])]
    df = spark.createDataFrame([p[:3] for p in points] + [(90, -10.01, 20.0), (91, 1000.0, 0.0), (92, None, 3.0)], "k int, x double, y double")
    got = {r["k"]: r["value"] for r in rasters.sampled(df, path, "x", "y", most).collect()}
    assert got == {k: back.get(at) for k, _, _, at in points} | {90: None, 91: None, 92: None}
    reader = rasters.RasterReader({"path": path})
    assert list(reader.pushFilters([rasters.In(("block",), ("0:0", "32:16")), rasters.GreaterThan(("band",), 3)])) == [rasters.GreaterThan(("band",), 3)]
    assert [b[4:6] for p in reader.partitions() for b in p.blocks] == [(0, 0), (32, 16)]


def test_rasters_of_other_forms(tmp_path):
    import io
    import struct

    import numpy as np

    from soilspark.sources import rasters

    x = np.arange(24, dtype=">i2").reshape(4, 3, 2)  # strips of two rows, two bands in turn, differences along rows, big-endian, eight-byte places
    steps = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1).astype(">i2")
    strips = [steps[:2].tobytes(), steps[2:].tobytes()]
    tags = [(256, 3, [3]), (257, 3, [4]), (258, 3, [16, 16]), (259, 3, [1]), (273, 16, [16, 40]), (277, 3, [2]), (278, 3, [2]), (279, 16, [24, 24]), (317, 3, [2]), (339, 3, [2, 2])]
    body, at, entries = b"".join(strips), 64, []
    for tag, kind, v in tags:
        raw = struct.pack(f">{len(v)}{rasters._KINDS[kind]}", *v)
        entries.append(struct.pack(">HHQ", tag, kind, len(v)) + (raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack(">Q", at)))
        if len(raw) > 8:
            body, at = body + raw, at + len(raw)
    file = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at) + body + struct.pack(">Q", len(entries)) + b"".join(entries)
    (tmp_path / "b.tif").write_bytes(file)
    tags = rasters.directory(io.BytesIO(file))
    assert tags[256] == (3,) and tags[273] == (16, 40)
    reader = rasters.RasterReader({"path": str(tmp_path / "b.tif")})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["band"], r["row0"]) for r in rows] == [(0, 0), (1, 0), (0, 2), (1, 2)]
    assert rows[3]["values"] == x[2:, :, 1].ravel().tolist()
    with pytest.raises(ValueError, match="no TIFF"):
        rasters.directory(io.BytesIO(b"PK" + b"\0" * 30))


def test_grids_are_read_by_cells_and_steps(spark, tmp_path, monkeypatch):
    import numpy as np

    from soilspark.sources import grids

    rng = np.random.default_rng(2)
    full = rng.normal(size=(10, 5, 7))
    full[3, 2, 2] = np.nan
    y, x = [50.0 - k * 0.5 for k in range(5)], [-100.0 + k * 0.25 for k in range(7)]
    rows = [(t, i, j, None if np.isnan(v) else float(v)) for t, a in enumerate(full) for i, b in enumerate(a) for j, v in enumerate(b)]
    path = f"file://{tmp_path}/g"
    grids.write(spark.createDataFrame(rows, "t int, i int, j int, value double").repartition(3), path, "pr", y, x, steps=4)
    back = grids.read(spark, path, "pr", partitionSteps="3")
    assert {(int(r["t"]), r["i"], r["j"]): r["value"] for r in back.collect()} == {r[:3]: r[3] for r in rows}
    some = back.where("i = 2 and j >= 5 and t > 6")
    assert {(int(r["t"]), r["j"], r["value"]) for r in some.collect()} == {(t, j, float(full[t, 2, j])) for t in (7, 8, 9) for j in (5, 6)}
    points = spark.createDataFrame([(1, -100.1, 49.1), (2, -98.9, 48.1), (3, -500.0, 90.0), (4, None, 1.0)], "k int, x double, y double")
    for most in (0, 100):
        got = {(r["k"], int(r["t"])): r["value"] for r in grids.series(points, path, "pr", "x", "y", most).collect()}
        assert got == {(k, t): float(full[t, i, j]) for k, i, j in ((1, 2, 0), (2, 4, 4), (3, 0, 0)) for t in range(10)}
    read, asked = grids.values, []
    monkeypatch.setattr(grids, "values", lambda f, h, n, *more: asked.append((n, more)) or read(f, h, n, *more))
    reader = grids.GridReader({"path": path, "variable": "pr"})
    assert list(reader.pushFilters([grids.In(("cell",), ("2:1", "2:4", "9:9")), grids.GreaterThan(("value",), 0)])) == [grids.GreaterThan(("value",), 0)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20
    assert {more[1:] for n, more in asked if n == "pr"} == {(2 * 7 + 1, 4)}


def test_packed_numbers_of_grids():
    import io
    import struct

    from soilspark.sources import grids

    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda k, v: text(k) + struct.pack(">iid", 6, 1, v)
    more = struct.pack(">ii", 12, 3) + number("scale_factor", 0.1) + number("add_offset", 5.0) + text("_FillValue") + struct.pack(">iihxx", 3, 1, -1)
    head = b"CDF\1" + struct.pack(">iii", 0, 10, 2) + text("y") + struct.pack(">i", 1) + text("x") + struct.pack(">i", 3) + struct.pack(">iiii", 0, 0, 11, 1) + text("v") + struct.pack(">iii", 2, 0, 1) + more + struct.pack(">ii", 3, 8)
    file = io.BytesIO(head + struct.pack(">i", len(head) + 4) + struct.pack(">3h", 10, -1, 0))
    got = grids.values(file, grids.header(file), "v").tolist()
    assert got[0] == 6.0 and got[1] != got[1] and got[2] == 5.0
    with pytest.raises(ValueError, match="NetCDF"):
        grids.header(io.BytesIO(b"HDF5...."))
