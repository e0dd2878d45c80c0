"""Rasters in tiled TIFF files as a Spark data source, a row a block.

The directory of each file is read on the driver; its blocks (tiles, or strips) are dealt to partitions, and bounds on a block's place (``row0``, ``col0``) or name (``block``) are pushed down, so of a
large raster only the blocks that points lie in are read and unpacked. A raster may be a folder of files on one grid; it is written as such, a file for each ``SIDE`` x ``SIDE`` pixels, since no
task holds more.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from soilspark.sources.shapes import _at

SIDE = 1024  # pixels of a written file's side
TILE = 64
PART_BLOCKS = 64
MAX_BLOCKS = 20_000  # names of blocks that are pushed down
SCHEMA = "block string, band int, row0 long, col0 long, height int, width int, values array<double>"
_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
}
# fixed values of the format: sizes and codes of its kinds of values; numbers of its tags
_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, BANDS, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


def directory(file) -> dict[int, tuple]:
    """The tags of a file's first image; ``0`` holds the byte order."""
    file.seek(0)
    start = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    file.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    size, room = (20, 8) if big else (12, 4)
    raw, out = file.read(n * size), {0: (order,)}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, k * size)
        count = struct.unpack_from(order + ("Q" if big else "I"), raw, k * size + 4)[0]
        code = _KINDS.get(kind)
        if code is None:
            continue
        length = count * struct.calcsize(code)
        value = raw[k * size + size - room : k * size + size][:length]
        if length > room:
            file.seek(struct.unpack_from(order + ("Q" if big else "I"), raw, k * size + size - room)[0])
            value = file.read(length)
        out[tag] = (value,) if code == "c" else struct.unpack(f"{order}{count}{code}", value)
    return out


@dataclass(frozen=True)
class Grid:
    """Where pixels lie: the upper left corner of the first one, and their sizes. Rows go down."""

    left: float
    top: float
    width: float
    height: float


def _grid(tags: dict[int, tuple]) -> Grid:
    sx, sy, *_ = tags.get(SCALE, (1.0, 1.0))
    i, j, _, x, y, *_ = tags.get(TIE, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return Grid(x - i * sx, y + j * sy, sx, sy)


@dataclass
class Blocks(InputPartition):
    blocks: list[tuple] = field(default_factory=list)  # path, place in the file, bytes, band (-1: all in turn), row0, col0, height, width


def _listed(path: str, tags: dict[int, tuple], whole: Grid) -> list[tuple]:
    """The blocks of a file, their places on the grid of the whole raster."""
    own = _grid(tags)
    row, col = round((whole.top - own.top) / own.height), round((own.left - whole.left) / own.width)
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BANDS, (1,))[0]
    tiled = TILES in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(STRIP_ROWS, (height,))[0], height))
    at, sizes = (tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])
    across, down = -(-width // tw), -(-height // th)
    out = []
    for band in range(bands) if tags.get(PLANAR, (1,))[0] == 2 else [-1]:
        for k in range(across * down):
            i, j = divmod(k, across)
            n = k + max(band, 0) * across * down
            out.append((path, at[n], sizes[n], band, row + i * th, col + j * tw, min(th, height - i * th), min(tw, width - j * tw), th if tiled else min(th, height - i * th), tw))
    return out


def _values(raw: bytes, tags: dict[int, tuple], height: int, width: int, rows: int, cols: int, single: bool) -> np.ndarray:
    """(bands, height, width) of a block stored as ``rows`` x ``cols``; what the file calls no data is NaN."""
    packing = tags.get(PACKING, (1,))[0]
    if packing in (8, 32946):
        raw = zlib.decompress(raw)
    elif packing != 1:
        raise ValueError(f"compression {packing} is not read")
    bands = 1 if single else tags.get(BANDS, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags[BITS][0] // 8)
    x = np.frombuffer(raw, dtype=np.dtype(kind).newbyteorder(tags[0][0]), count=rows * cols * bands).reshape(rows, cols, bands)
    if tags.get(PREDICTOR, (1,))[0] == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype)
    elif tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("this predictor is not read")
    out = x[:height, :width].astype(float).transpose(2, 0, 1)
    if NODATA in tags:
        out[out == float(tags[NODATA][0].strip(b"\0 "))] = np.nan
    return out


def _name(row: int, col: int) -> str:
    return f"{row}:{col}"


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partitionblocks", PART_BLOCKS))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("row0", "col0", "block"):
                self.filters.append(f if not isinstance(f, In) else In(f.attribute, frozenset(f.value)))
            else:
                yield f

    def wanted(self, row0: int, col0: int) -> bool:
        own = {"row0": row0, "col0": col0, "block": _name(row0, col0)}
        return all(_TESTS[type(f)](own[f.attribute[0]], f) for f in self.filters)

    def partitions(self):
        blocks = [b for b in every(self.path)[1] if self.wanted(b[4], b[5])]
        return [Blocks(blocks[k : k + self.part]) for k in range(0, len(blocks), self.part)] or [Blocks([])]

    def read(self, partition: Blocks):
        store, _ = _at(self.path)
        schema = pa.schema([("block", pa.string()), ("band", pa.int32()), ("row0", pa.int64()), ("col0", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("values", pa.list_(pa.float64()))])
        open_: tuple = ()
        for path, at, size, band, row0, col0, height, width, rows, cols in partition.blocks:
            if not open_ or open_[0] != path:
                file = store.open_input_file(path)
                open_ = (path, file, directory(file))
            open_[1].seek(at)
            values = _values(open_[1].read(size), open_[2], height, width, rows, cols, band >= 0)
            out = [(_name(row0, col0), max(band, 0) + k, row0, col0, height, width, pa.array(v.ravel(), mask=np.isnan(v.ravel())).to_pylist()) for k, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)


def every(path: str) -> tuple[Grid, list[tuple]]:
    """The grid of a raster, of its upper and left edges, and all its blocks."""
    store, at = _at(path)
    if at.endswith((".tif", ".tiff")):
        paths = [at]
    else:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        paths = sorted(x.path for x in found if x.path.endswith((".tif", ".tiff")) and not x.base_name.startswith("."))
    tags = {}
    for p in paths:
        with store.open_input_file(p) as f:
            tags[p] = directory(f)
    if not tags:
        raise FileNotFoundError(f"no raster in {path}")
    grids = [_grid(t) for t in tags.values()]
    if len({(g.width, g.height) for g in grids}) > 1:
        raise ValueError("pixels of several sizes")
    whole = Grid(min(g.left for g in grids), max(g.top for g in grids), grids[0].width, grids[0].height)
    return whole, [b for p, t in tags.items() for b in _listed(p, t, whole)]


class Rasters(DataSource):
    @classmethod
    def name(cls):
        return "rasterblocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return RasterReader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """block, band, row0, col0, height, width, values (row by row; null: no data) of the blocks of a file or of a folder of files on one grid."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rasters)
    return spark.read.format("rasterblocks").options(**options).load(path)


def sampled(points: DataFrame, path: str, x: str, y: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``points`` with band and value of the pixel that they lie in; points outside the raster and unknown pixels have a null value, for the former band is null too.

    The blocks that points lie in are told first; if they are at most ``max_blocks``, only these are read.
    """
    spark = points.sparkSession
    grid, blocks = every(path)
    height, width = max(b[8] for b in blocks), max(b[9] for b in blocks)
    regular = all(b[4] % height == 0 and b[5] % width == 0 for b in blocks)
    row, col = F.floor((grid.top - F.col(y)) / grid.height), F.floor((F.col(x) - grid.left) / grid.width)
    if not regular:
        raise ValueError("the blocks of the files do not lie on one grid of blocks")
    placed = points.withColumns({"__row": row.cast("long"), "__col": col.cast("long")})
    own = F.concat_ws(":", (F.col("__row") - F.pmod("__row", F.lit(height))).cast("string"), (F.col("__col") - F.pmod("__col", F.lit(width))).cast("string"))
    placed = placed.withColumn("block", own)
    held = read(spark, path)
    wanted = [r["block"] for r in placed.select("block").distinct().limit(max_blocks + 1).collect()]
    if len(wanted) <= max_blocks:
        held = held.where(F.col("block").isin(wanted))
    at = (F.col("__row") - F.col("row0")) * F.col("width") + F.col("__col") - F.col("col0")
    inside = (F.col("__row") - F.col("row0") < F.col("height")) & (F.col("__col") - F.col("col0") < F.col("width"))
    out = placed.join(held, "block", "left").withColumn("value", F.when(inside, F.get("values", at.cast("int"))))
    return out.withColumn("band", F.when(inside, F.col("band"))).select(*points.columns, "band", "value")


def write(pixels: DataFrame, path: str, grid: Grid, nodata: float = -9999.0, side: int = SIDE, tile: int = TILE) -> None:
    """(row, col, value) as tiled, packed files of one band below ``path``, a file for each ``side`` x ``side`` pixels that any of the rows lies in; pixels without a row, or with a null
    value, are ``nodata``. ``side`` is a multiple of ``tile``. A file is put in place under its name once it is whole, so a task that runs twice does no harm."""
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)

    def file(key: tuple, group: pa.Table) -> pa.Table:
        x = np.full((side, side), nodata)
        value = group.column("value").fill_null(nodata).to_numpy()
        x[group.column("row").to_numpy() - key[0].as_py() * side, group.column("col").to_numpy() - key[1].as_py() * side] = value
        name = f"r{key[0].as_py()}_c{key[1].as_py()}.tif"
        own, where = _at(path)
        before = f"{where}/.{uuid.uuid4().hex}"
        with own.open_output_stream(before) as f:
            f.write(packed(x, Grid(grid.left + key[1].as_py() * side * grid.width, grid.top - key[0].as_py() * side * grid.height, grid.width, grid.height), nodata, tile))
        own.move(before, f"{where}/{name}")
        return pa.table({"name": [name]})

    files = [F.floor(F.col(c) / side).cast("long").alias(k) for c, k in (("row", "i"), ("col", "j"))]
    keyed = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"), *files)
    keyed.groupBy("i", "j").applyInArrow(file, "name string").write.format("noop").mode("overwrite").save()


def packed(x: np.ndarray, grid: Grid, nodata: float, tile: int = TILE) -> bytes:
    """A TIFF file of one band of doubles."""
    height, width = x.shape
    blocks = [zlib.compress(x[i : i + tile, j : j + tile].astype("<f8").tobytes()) for i in range(0, height, tile) for j in range(0, width, tile)]
    text = f"{nodata!r}".encode() + b"\0"
    at, data, entries = 8, list(blocks), []
    places = np.cumsum([at, *map(len, blocks)])
    at = int(places[-1])
    tags: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [64]), (PACKING, 3, [8]), (262, 3, [1]), (BANDS, 3, [1]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]),
        (TILES, 4, places[:-1].tolist()),
        (TILE_SIZES, 4, [len(b) for b in blocks]), (FORMAT, 3, [3]), (SCALE, 12, [grid.width, grid.height, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, grid.left, grid.top, 0.0]), (NODATA, 2, text),
    ]
    for tag, kind, value in tags:
        raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_KINDS[kind]}", *value)
        count = len(value)
        if len(raw) > 4:
            data.append(raw)
            entries.append(struct.pack("<HHII", tag, kind, count, at))
            at += len(raw)
        else:
            entries.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0"))
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(data) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4


def rows_of(blocks: DataFrame) -> DataFrame:
    """(band, row, col, value) of every pixel of ``blocks``."""
    each = blocks.select("band", "row0", "col0", "width", F.posexplode("values").alias("k", "value"))
    return each.select("band", (F.col("row0") + F.floor(F.col("k") / F.col("width"))).alias("row"), (F.col("col0") + F.col("k") % F.col("width")).alias("col"), "value")

