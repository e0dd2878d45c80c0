"""Shapefiles as a Spark data source: points, lines and polygons with their attributes.

A file's index is read on the driver, and its records are dealt to partitions by their number, so a large file is read by many tasks, each from its own offset. Bounds
on a record's box (``x0``, ``y0``, ``x1``, ``y1``) are pushed down: of records outside them only the few bytes of the box are read, neither points nor attributes. Writing makes a
file set for each ``ROLL`` rows of a task; they count once the job's manifest names them.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

PART = 50_000  # records of a partition
ROLL = 100_000  # records of a file
# fixed values of the format: kinds of shapes, and the versions and codes that its headers hold
POINT, LINE, POLYGON = 1, 3, 5
CODE, VERSION = 9994, 1000
BOX = ("x0", "y0", "x1", "y1")
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_TESTS = {EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# attributes


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    width: int
    decimals: int

    def arrow(self) -> pa.DataType:
        if self.kind == "N" and not self.decimals:
            return pa.int64()
        return {"N": pa.float64(), "F": pa.float64(), "D": pa.date32(), "L": pa.bool_()}.get(self.kind, pa.string())

    def read(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").rstrip(" \0")
        if self.kind in "NFDL":
            text = text.strip()
            if not text or text[0] == "*" or text == "?" or self.kind == "D" and not text.isdigit():
                return None
            if self.kind == "D":
                return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            return text in "TtYy" if self.kind == "L" else int(text) if self.arrow() == pa.int64() else float(text)
        return text or None

    def write(self, value) -> bytes:
        if value is None:
            raw = b""
        elif self.kind == "D":
            raw = value.strftime("%Y%m%d").encode()
        elif self.kind == "L":
            raw = b"T" if value else b"F"
        else:
            raw = (repr(value) if self.kind == "F" else str(value)).encode()
        return raw.ljust(self.width) if self.kind in "CDL" else raw.rjust(self.width)


def table_head(raw: bytes) -> tuple[int, int, int, list[Column]]:
    """(rows, bytes before them, bytes of a row, columns) of an attribute table."""
    rows, head, size = struct.unpack_from("<IHH", raw, 4)
    columns = []
    for at in range(32, head - 1, 32):
        if raw[at] == 0x0D:
            break
        columns.append(Column(raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return rows, head, size, columns


def _columns(schema: pa.Schema, rows: list[dict]) -> list[Column]:
    out = []
    for f in schema:
        if len(f.name.encode()) > 10:
            raise ValueError(f"{f.name}: names of attributes have at most 10 bytes")
        if pa.types.is_integer(f.type):
            out.append(Column(f.name, "N", 20, 0))
        elif pa.types.is_floating(f.type):
            out.append(Column(f.name, "F", 24, 15))
        elif pa.types.is_date(f.type):
            out.append(Column(f.name, "D", 8, 0))
        elif pa.types.is_boolean(f.type):
            out.append(Column(f.name, "L", 1, 0))
        else:
            width = max([1, *(len(str(r[f.name]).encode()) for r in rows if r[f.name] is not None)])
            if width > 254:
                raise ValueError(f"{f.name}: texts of attributes have at most 254 bytes")
            out.append(Column(f.name, "C", width, 0))
    return out


# shapes


def packed(kind: int, rings: list) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """A record's content and its box. A point is a ring of one place."""
    if not rings or not any(rings):
        return struct.pack("<i", 0), None
    flat = np.array([(p["x"], p["y"]) for ring in rings for p in ring], dtype="<f8")
    box = (*flat.min(axis=0).tolist(), *flat.max(axis=0).tolist())
    if kind == POINT:
        return struct.pack("<i", POINT) + flat[0].tobytes(), box
    starts = np.cumsum([0, *map(len, rings[:-1])], dtype="<i4")
    return struct.pack("<i4dii", kind, *box, len(rings), len(flat)) + starts.tobytes() + flat.tobytes(), box


def unpacked(content: bytes) -> list | None:
    """The rings of a record's content; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind in (POINT, POINT + 10, POINT + 20):
        x, y = struct.unpack_from("<2d", content, 4)
        return [[{"x": x, "y": y}]]
    if kind % 10 not in (LINE, POLYGON):
        raise ValueError(f"shapes of kind {kind} are not read")
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*np.frombuffer(content, "<i4", parts, 44).tolist(), points]
    flat = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    return [[{"x": x, "y": y} for x, y in flat[a:b]] for a, b in zip(starts, starts[1:], strict=False)]


@dataclass
class Range(InputPartition):
    path: str = ""
    first: int = 0
    count: int = 0


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.part = options["path"], int(options.get("partitionrecords", PART))
        self.names = names
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, box: tuple[float, ...] | None) -> bool:
        return not self.filters or box is not None and all(_TESTS[type(f)](box[BOX.index(f.attribute[0])], f.value) for f in self.filters)

    def partitions(self):
        store, _ = _at(self.path)
        out = []
        for path in _files(self.path):
            n = (store.get_file_info(path[:-4] + ".shx").size - 100) // 8
            out += [Range(path, k, min(self.part, n - k)) for k in range(0, n, self.part)]
        return out or [Range()]

    def read(self, partition: Range):
        if not partition.count:
            return
        store, _ = _at(self.path)
        stem = partition.path[:-4]
        with store.open_input_file(stem + ".shx") as f:
            f.seek(100 + 8 * partition.first)
            index = np.frombuffer(f.read(8 * partition.count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        kinds = _schema(store, stem)
        rows: list[dict] = []
        with store.open_input_file(partition.path) as shp, store.open_input_file(stem + ".dbf") as dbf:
            _, head, size, columns = table_head(_head(dbf))
            encoding = _encoding(store, stem)
            for k, (at, length) in enumerate(index.tolist(), partition.first):
                shp.seek(at + 8)
                start = shp.read(min(length, 36))
                kind = struct.unpack_from("<i", start)[0]
                box = None if kind == 0 else struct.unpack_from("<4d", start, 4) if kind % 10 != POINT else struct.unpack_from("<2d", start, 4) * 2
                if not self.wanted(box):
                    continue
                rings = unpacked(start + shp.read(length - len(start)))
                dbf.seek(head + k * size)
                raw, at_column = dbf.read(size), 1
                row = {"record": k, "kind": kind, **dict(zip(BOX, box or (None,) * 4, strict=True)), "rings": rings}
                for c in columns:
                    row[c.name] = c.read(raw[at_column : at_column + c.width], encoding)
                    at_column += c.width
                rows.append(row)
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _head(file) -> bytes:
    start = file.read(32)
    return start + file.read(struct.unpack_from("<H", start, 8)[0] - 32)


def _encoding(store: fs.FileSystem, stem: str) -> str:
    if store.get_file_info(stem + ".cpg").type == fs.FileType.NotFound:
        return "latin-1"
    with store.open_input_stream(stem + ".cpg") as f:
        said = f.read().lower()
    return "utf-8" if b"utf" in said or b"65001" in said else "latin-1"


def _schema(store: fs.FileSystem, stem: str) -> pa.Schema:
    with store.open_input_file(stem + ".dbf") as f:
        columns = table_head(_head(f))[3]
    own = [("record", pa.int64()), ("kind", pa.int32()), *[(c, pa.float64()) for c in BOX], ("rings", _RINGS)]
    return pa.schema([*own, *[(c.name, c.arrow()) for c in columns]])


def _files(path: str) -> list[str]:
    """The files to be read: of those that this module wrote the ones that a manifest names, all others."""
    store, at = _at(path)
    if at.endswith(".shp"):
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    named: set[str] = set()
    for x in found:
        if x.base_name.startswith("_shapes-"):
            with store.open_input_stream(x.path) as f:
                named |= set(json.loads(f.read()))
    return sorted(x.path for x in found if x.path.endswith(".shp") and (not x.base_name.startswith("part-") or x.base_name in named))


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class ShapeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.job = options["path"], int(options.get("kind", POLYGON)), uuid.uuid4().hex
        self.roll = int(options.get("filerecords", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]):
        names, rows, schema = [], [], None
        for batch in iterator:
            schema = pa.schema([f for f in batch.schema if f.name != "rings"])
            rows += batch.to_pylist()
            while len(rows) >= self.roll:
                names.append(self._file(rows[: self.roll], schema))
                rows = rows[self.roll :]
        if rows:
            names.append(self._file(rows, schema))
        return Written(names)

    def _file(self, rows: list[dict], schema: pa.Schema) -> str:
        store, folder = _at(self.path)
        stem = f"part-{self.job}-{uuid.uuid4().hex}"
        shapes, index, at, boxes = [], [], 50, []
        for k, row in enumerate(rows, 1):
            content, box = packed(self.kind, row["rings"])
            shapes.append(struct.pack(">ii", k, len(content) // 2) + content)
            index.append(struct.pack(">ii", at, len(content) // 2))
            at += 4 + len(content) // 2
            boxes += [box] if box else []
        bounds = (*np.min(boxes, axis=0)[:2], *np.max(boxes, axis=0)[2:]) if boxes else (0.0,) * 4
        head = lambda words: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, self.kind, *bounds, 0, 0, 0, 0)
        columns = _columns(schema, rows)
        size = 1 + sum(c.width for c in columns)
        table = struct.pack("<4BIHH20x", 3, 95, 7, 26, len(rows), 33 + 32 * len(columns), size)
        table += b"".join(struct.pack("<11sc4xBB14x", c.name.encode(), c.kind.encode(), c.width, c.decimals) for c in columns) + b"\r"
        body = b"".join(b" " + b"".join(c.write(r[c.name]) for c in columns) for r in rows)
        for ending, parts in (("shp", [head(at), *shapes]), ("shx", [head(50 + 4 * len(rows)), *index]), ("dbf", [table, body, b"\x1a"]), ("cpg", [b"UTF-8"])):
            with store.open_output_stream(f"{folder}/{stem}.{ending}") as f:
                f.write(b"".join(parts))
        return f"{stem}.shp"

    def commit(self, messages):
        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_shapes-{self.job}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        store, folder = _at(self.path)
        for m in messages:
            for n in m.names if m else []:
                for ending in ("shp", "shx", "dbf", "cpg"):
                    store.delete_file(f"{folder}/{n[:-3]}{ending}")


class Shapes(DataSource):
    @classmethod
    def name(cls):
        return "shapes"

    def schema(self):
        store, _ = _at(self.options["path"])
        paths = _files(self.options["path"])
        if not paths:
            raise FileNotFoundError(f"no shapefile in {self.options['path']}")
        return from_arrow_schema(_schema(store, paths[0][:-4]))

    def reader(self, schema: StructType):
        return ShapeReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool):
        return ShapeWriter(dict(self.options), schema)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """record, kind, x0, y0, x1, y1 (the box), rings (array of arrays of places) and the attributes of every shape of a file or a folder of files alike. A null shape has neither box nor rings."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapes)
    return spark.read.format("shapes").options(**options).load(path)


def write(df: DataFrame, path: str, kind: int = POLYGON, **options) -> None:
    """``df`` (rings and attributes: numbers, texts of at most 254 bytes, dates, booleans; names of at most 10 bytes) as shapefiles below ``path``; what is there stays."""
    df.sparkSession.dataSource.register(Shapes)
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)
    df.write.format("shapes").mode("append").options(kind=kind, **options).save(path)
