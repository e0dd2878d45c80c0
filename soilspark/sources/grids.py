"""Gridded series in NetCDF files of the classic forms as a Spark data source: a row a step and cell.

A file's header is read on the driver; its steps are dealt to partitions. Bounds on the row and column of a cell (``i``, ``j``), its name (``cell``) and the step (``t``) are
pushed down: of each step only the rows that hold wanted cells are read, from the first to the last of these, so the series of a few points costs a few strided reads and not the grid. A series may
be a folder of files on one grid that follow one another in time; it is written as such, a file for each ``STEPS`` steps.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from soilspark.sources.shapes import _at

STEPS = 64  # of a written file
PART_STEPS = 32
MAX_CELLS = 20_000  # names of cells that are pushed down
SCHEMA = "cell string, t double, i long, j long, value double"
# fixed values of the format: its kinds of values and the marks of its lists
_KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
}


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    kind: str
    at: int
    unlimited: bool  # its first dimension is the one that grows: a step every ``stride`` bytes
    attributes: dict


@dataclass(frozen=True)
class Header:
    sizes: dict[str, int]
    variables: dict[str, Variable]
    stride: int


def header(file) -> Header:
    """Dimensions and variables of an open file."""
    file.seek(0)
    magic = file.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("no NetCDF file of a classic form")
    number = lambda: struct.unpack(">i", file.read(4))[0]
    place = number if magic[3] == 1 else lambda: struct.unpack(">q", file.read(8))[0]
    padded = lambda n: file.read(n + -n % 4)[:n]
    name = lambda: padded(number()).decode()

    def attributes() -> dict:
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            raw = np.frombuffer(padded(n * np.dtype(_KINDS[kind]).itemsize), _KINDS[kind])
            out[key] = raw.tobytes().decode("utf-8", "replace") if kind == 2 else raw.tolist()[0] if n == 1 else raw.tolist()
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    variables, lengths = {}, []
    for _ in range(number()):
        key = name()
        ids = [number() for _ in range(number())]
        more, kind, size, at = attributes(), number(), number(), place()
        grows = bool(ids) and dims[ids[0]][1] == 0
        variables[key] = Variable(tuple(dims[k][0] for k in ids), _KINDS[kind], at, grows, more)
        if grows:
            lengths.append(size if size >= 0 else size + (1 << 32))
    stride = sum(lengths)
    if len(lengths) == 1:  # a variable that grows alone is not padded
        (v,) = (v for v in variables.values() if v.unlimited)
        stride = np.dtype(v.kind).itemsize * int(np.prod([n for d, n in dims if d in v.dims[1:]], dtype=np.int64))
    return Header({d: n or records for d, n in dims}, variables, stride)


def values(file, head: Header, name: str, step: int | None = None, begin: int = 0, count: int | None = None) -> np.ndarray:
    """A variable's values, or ``count`` of those of one step from the one at ``begin`` on; unpacked, what is missing NaN."""
    v = head.variables[name]
    rest = int(np.prod([head.sizes[d] for d in v.dims[(0 if step is None else 1) :]], dtype=np.int64)) if v.dims else 1
    size = np.dtype(v.kind).itemsize
    if step is None and v.unlimited:
        return np.concatenate([values(file, head, name, k) for k in range(head.sizes[v.dims[0]])])
    n = rest if count is None else count
    file.seek(v.at + (0 if step is None else step * (head.stride if v.unlimited else rest * size)) + begin * size)
    raw = np.frombuffer(file.read(n * size), v.kind)
    out = raw.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in v.attributes:
            out[raw == np.asarray(v.attributes[key]).astype(v.kind)] = np.nan
    return out * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)


def _paths(path: str) -> list[str]:
    store, at = _at(path)
    if at.endswith(".nc"):
        return [at]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".nc") and not x.base_name.startswith("."))


def coordinates(path: str, variable: str) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of rows and of columns of a variable's grid."""
    store, _ = _at(path)
    with store.open_input_file(_paths(path)[0]) as f:
        head = header(f)
        _, y, x = head.variables[variable].dims
        return values(f, head, y), values(f, head, x)


@dataclass
class Span(InputPartition):
    path: str = ""
    first: int = 0
    count: int = 0


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable, self.part = options["path"], options["variable"], int(options.get("partitionsteps", PART_STEPS))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("cell", "t", "i", "j"):
                self.filters.append(In(f.attribute, frozenset(f.value)) if isinstance(f, In) else f)
            else:
                yield f

    def _fits(self, **own) -> bool:
        return all(_TESTS[type(f)](own[f.attribute[0]], f) for f in self.filters if f.attribute[0] in own)

    def partitions(self):
        store, _ = _at(self.path)
        out = []
        for path in _paths(self.path):
            with store.open_input_file(path) as f:
                head = header(f)
            n = head.sizes[head.variables[self.variable].dims[0]]
            out += [Span(path, k, min(self.part, n - k)) for k in range(0, n, self.part)]
        return out or [Span()]

    def cells(self, rows: int, cols: int) -> dict[int, np.ndarray]:
        """The wanted columns of each row that has any."""
        named = [f for f in self.filters if f.attribute[0] == "cell" and isinstance(f, (In, EqualTo))]
        if named:
            names = named[0].value if isinstance(named[0], In) else [named[0].value]
            found = [tuple(map(int, n.split(":"))) for n in names if n.replace(":", "", 1).isdigit()]
        else:
            own_rows, own_cols = ([k for k in range(n) if self._fits(**{c: k})] for c, n in (("i", rows), ("j", cols)))
            found = [(i, j) for i in own_rows for j in own_cols] if any(f.attribute[0] == "cell" for f in self.filters) else []
            if not found and not any(f.attribute[0] == "cell" for f in self.filters):
                return {i: np.array(own_cols) for i in own_rows} if own_cols else {}
        out: dict[int, list[int]] = {}
        for i, j in found:
            if i < rows and j < cols and self._fits(cell=f"{i}:{j}", i=i, j=j):
                out.setdefault(i, []).append(j)
        return {i: np.array(sorted(js)) for i, js in sorted(out.items())}

    def read(self, partition: Span):
        if not partition.count:
            return
        store, _ = _at(self.path)
        schema = pa.schema([("cell", pa.string()), ("t", pa.float64()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.float64())])
        with store.open_input_file(partition.path) as f:
            head = header(f)
            time, y, x = head.variables[self.variable].dims
            rows, cols = head.sizes[y], head.sizes[x]
            cells = self.cells(rows, cols)
            for k in range(partition.first, partition.first + partition.count):
                t = float(values(f, head, time, k, 0, 1)[0]) if time in head.variables else float(k)
                if not cells or not self._fits(t=t):
                    continue
                for i, js in cells.items():
                    row = values(f, head, self.variable, k, i * cols + int(js[0]), int(js[-1] - js[0]) + 1)[js - js[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{i}:{j}" for j in js]), pa.array(np.full(len(js), t)), pa.array(np.full(len(js), i)), pa.array(js.astype(np.int64)), pa.array(row, mask=np.isnan(row))], schema=schema)


class Grids(DataSource):
    @classmethod
    def name(cls):
        return "gridseries"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return GridReader(dict(self.options))


def read(spark: SparkSession, path: str, variable: str, **options) -> DataFrame:
    """cell (``row:column``), t (the time's own value, else the step), i, j and value (null: missing) of a variable by time, row and column."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Grids)
    return spark.read.format("gridseries").options(variable=variable, **options).load(path)


def series(points: DataFrame, path: str, variable: str, x: str, y: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """``points`` with t and value of the nearest cell at every step; points beyond the grid take its edge, points without a place have no rows.

    Rows and columns are evenly spaced, in either direction. The cells that points lie in are told first; if they are at most ``max_cells``, only these are read.
    """
    at = []
    for c, own in ((y, coordinates(path, variable)[0]), (x, coordinates(path, variable)[1])):
        step = float(own[-1] - own[0]) / (len(own) - 1) if len(own) > 1 else 1.0
        if len(own) > 1 and not np.allclose(np.diff(own), step, rtol=1e-3):
            raise ValueError(f"{c}: the grid is not evenly spaced")
        at.append(F.greatest(F.lit(0), F.least(F.lit(len(own) - 1), F.round((F.col(c) - float(own[0])) / step))).cast("long").cast("string"))
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    placed = points.where(known).withColumn("__cell", F.concat_ws(":", *at))
    held = read(points.sparkSession, path, variable)
    wanted = [r["__cell"] for r in placed.select("__cell").distinct().limit(max_cells + 1).collect()]
    if len(wanted) <= max_cells:
        held = held.where(F.col("cell").isin(wanted))
    return placed.join(held.select(F.col("cell").alias("__cell"), "t", "value"), "__cell").select(*points.columns, "t", "value")


def write(pixels: DataFrame, path: str, variable: str, y: list[float], x: list[float], steps: int = STEPS, missing: float = -9999.0) -> None:
    """(t, i, j, value), t a whole number, as files of one variable below ``path``, one for each ``steps`` steps that have any rows. What has no row, or a null value, is missing. A file is put in
    place once it is whole."""
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)

    def file(key: tuple, group: pa.Table) -> pa.Table:
        first = key[0].as_py() * steps
        t = group.column("t").to_numpy()
        own = np.unique(t)
        grid = np.full((len(own), len(y), len(x)), missing)
        grid[np.searchsorted(own, t), group.column("i").to_numpy(), group.column("j").to_numpy()] = group.column("value").fill_null(missing).to_numpy()
        out, where = _at(path)
        before = f"{where}/.{uuid.uuid4().hex}"
        with out.open_output_stream(before) as f:
            f.write(packed(variable, own.astype(float), y, x, grid, missing))
        out.move(before, f"{where}/t{first:012d}.nc")
        return pa.table({"first": [first]})

    keyed = pixels.select(*[F.col(c).cast("long") for c in ("t", "i", "j")], F.col("value").cast("double"), F.floor(F.col("t") / steps).cast("long").alias("part"))
    keyed.groupBy("part").applyInArrow(file, "first long").write.format("noop").mode("overwrite").save()


def packed(variable: str, t: np.ndarray, y: list[float], x: list[float], grid: np.ndarray, missing: float) -> bytes:
    """A file of one variable of doubles by time (which grows), row and column."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    nothing = struct.pack(">ii", 0, 0)
    fill = struct.pack(">ii", ATTRIBUTES, 1) + text("_FillValue") + struct.pack(">iid", 6, 1, missing)
    head = b"CDF\2" + struct.pack(">iii", len(t), DIMENSIONS, 3) + b"".join(text(d) + struct.pack(">i", n) for d, n in (("time", 0), ("lat", len(y)), ("lon", len(x)))) + nothing
    one = 8 * len(y) * len(x)
    sizes = {"lat": 8 * len(y), "lon": 8 * len(x), "time": 8, variable: one}
    ids = {"lat": (1,), "lon": (2,), "time": (0,), variable: (0, 1, 2)}

    def listed(begin: dict[str, int]) -> bytes:
        parts = [text(v) + struct.pack(f">i{len(k)}i", len(k), *k) + (fill if v == variable else nothing) + struct.pack(">iiq", 6, sizes[v], begin[v]) for v, k in ids.items()]
        return head + struct.pack(">ii", VARIABLES, len(ids)) + b"".join(parts)

    at = len(listed(dict.fromkeys(ids, 0)))
    begin = {"lat": at, "lon": at + sizes["lat"], "time": at + sizes["lat"] + sizes["lon"]}
    begin[variable] = begin["time"] + 8
    steps = b"".join(struct.pack(">d", s) + g.astype(">f8").tobytes() for s, g in zip(t, grid, strict=True))
    return listed(begin) + np.array(y, dtype=">f8").tobytes() + np.array(x, dtype=">f8").tobytes() + steps
