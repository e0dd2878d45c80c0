"""Archives of station files as a Spark data source: zip files whose members are a sensor's record each.

A member is named ``<network>/<station>/<network>_<station>_<variable>_<from>_<to>_<sensor>_<first>_<last>.stm`` (depths in metres); its first line repeats network and station
and adds latitude, longitude, elevation, depths and sensor; each further line is ``yyyy/mm/dd hh:mm value flag``. The driver reads the directories of a few small archives and deals their
members to partitions by their size; larger or more ones it deals by ranges of their bytes, and tasks read the directories and take the members that begin in their range.
Bounds on what a name tells (network, station, variable, depths, sensor) are pushed down: members outside them are not opened, and none is read beyond its header for nothing.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from soilspark.sources.shapes import _at

PART_BYTES = 32 << 20  # of members' compressed bytes in a partition
LISTED_BYTES = 1 << 20  # of archives in all, up to which the driver reads their directories
BATCH = 5000  # rows handed on at once, of one member or several
SCHEMA = "network string, station string, variable string, depth_from double, depth_to double, sensor string, latitude double, longitude double, elevation double, date_time timestamp, value double, flag string"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("network", "station", "variable")] + [(c, pa.float64()) for c in ("depth_from", "depth_to")]
    + [("sensor", pa.string())] + [(c, pa.float64()) for c in ("latitude", "longitude", "elevation")]
    + [("date_time", pa.timestamp("us", tz="UTC")), ("value", pa.float64()), ("flag", pa.string())]
)
NAMED = ("network", "station", "variable", "depth_from", "depth_to", "sensor")
_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value, StringStartsWith: lambda v, f: v.startswith(f.value),
}
# fixed values of the format: what ends a member's name, and how it writes times
ENDING, TIME = ".stm", "%Y/%m/%d %H:%M"


def told(name: str) -> dict | None:
    """What a member's name says; None if it is none of a record. Stations, variables and sensors may hold ``_``: depths are the first two numbers side by side."""
    parts = name.rpartition("/")[2].removesuffix(ENDING).split("_")
    folders = name.split("/")
    if not name.endswith(ENDING) or len(folders) < 3:
        return None
    network, station = folders[-3], folders[-2]
    head = f"{network}_{station}_"
    rest = name.rpartition("/")[2].removesuffix(ENDING)
    if not rest.startswith(head):
        return None
    parts = rest[len(head) :].split("_")
    for k in range(1, len(parts) - 4):
        try:
            lo, hi = float(parts[k]), float(parts[k + 1])
        except ValueError:
            continue
        return {"network": network, "station": station, "variable": "_".join(parts[:k]), "depth_from": lo, "depth_to": hi, "sensor": "_".join(parts[k + 2 : -2])}
    return None


@dataclass
class Members(InputPartition):
    members: list[tuple[str, str]] = field(default_factory=list)  # archive and member
    ranges: list[tuple[str, int, int]] = field(default_factory=list)  # archive and bytes in which members begin


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partitionbytes", PART_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in NAMED:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, name: str) -> dict | None:
        found = told(name)
        return found if found and all(_TESTS[type(f)](found[f.attribute[0]], f) for f in self.filters) else None

    def partitions(self):
        store, _ = _at(self.path)
        out, room = [], 0
        found = _archives(self.path)
        if sum(size for _, size in found) > LISTED_BYTES:
            for path, size in found:
                for at in range(0, size, self.part):
                    if not out or room <= 0:
                        out.append(Members())
                        room = self.part
                    out[-1].ranges.append((path, at, min(at + self.part, size)))
                    room -= min(self.part, size - at)
            return out
        for path, _ in found:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for x in z.infolist():
                    if self.wanted(x.filename) is None:
                        continue
                    if not out or room < x.compress_size:
                        out.append(Members([]))
                        room = self.part
                    out[-1].members.append((path, x.filename))
                    room -= x.compress_size
        return out or [Members([])]

    def opened(self, partition: Members) -> Iterator[tuple[dict, zipfile.ZipExtFile]]:
        """What the names of a partition's members say, and the members, one after another."""
        store, _ = _at(self.path)
        by_path: dict[str, list] = {}
        for path, name in partition.members:
            by_path.setdefault(path, []).append(name)
        ranges = [(path, lambda z, names=names: names) for path, names in by_path.items()]
        ranges += [(path, lambda z, a=a, b=b: [x for x in z.infolist() if a <= x.header_offset < b]) for path, a, b in partition.ranges]
        for path, chosen in ranges:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for x in chosen(z):
                    told_of = self.wanted(x if isinstance(x, str) else x.filename)
                    if told_of is not None:
                        with z.open(x) as member:
                            yield told_of, member

    def read(self, partition: Members):
        held = {c: [] for c in _ARROW.names}
        for found, member in self.opened(partition):
            for times, values, flags, place in _lines(member):
                for c, v in (found | place).items():
                    held[c] += [v] * len(times)
                held["date_time"] += times
                held["value"] += values
                held["flag"] += flags
                if len(held["value"]) >= BATCH:
                    yield pa.RecordBatch.from_pydict(held, schema=_ARROW)
                    held = {c: [] for c in _ARROW.names}
        if held["value"]:
            yield pa.RecordBatch.from_pydict(held, schema=_ARROW)


def _lines(member) -> Iterator[tuple[list, list, list, dict]]:
    """Times, values and flags of up to ``BATCH`` lines of a member, and where its sensor is."""
    head = member.readline().decode().split()
    place: dict = dict.fromkeys(("latitude", "longitude", "elevation")) | dict(zip(("latitude", "longitude", "elevation"), map(float, head[2:5]), strict=False))
    while lines := list(islice(member, BATCH)):
        parts = [p for p in (x.decode().split() for x in lines) if len(p) >= 3]
        numbers = [float(p[2]) for p in parts]
        values = [None if v != v else v for v in numbers]
        yield [_time(p[0], p[1]) for p in parts], values, [p[3] if len(p) > 3 else None for p in parts], place


def _time(day: str, minute: str) -> datetime:
    if len(day) == 10 and len(minute) == 5:  # as the format has them; isoformat is read many times faster
        return datetime.fromisoformat(f"{day.replace('/', '-')}T{minute}+00:00")
    return datetime.strptime(f"{day} {minute} +0000", TIME + " %z")


def _archives(path: str) -> list[tuple[str, int]]:
    """The archives to be read and their sizes: of those that this module wrote the ones that a manifest names, all others."""
    store, at = _at(path)
    if at.endswith(".zip"):
        return [(at, store.get_file_info(at).size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    named: set[str] = set()
    for x in found:
        if x.base_name.startswith("_archives-"):
            with store.open_input_stream(x.path) as f:
                named |= set(json.loads(f.read()))
    return sorted((x.path, x.size) for x in found if x.path.endswith(".zip") and (not x.base_name.startswith("part-") or x.base_name in named))


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]):
        store, folder = _at(self.path)
        names: list[str] = []
        z = f = None
        try:
            for rows in _sensors(iterator):
                if z is not None and f.tell() >= PART_BYTES:  # so that a range is a whole archive, and its directory is read once
                    z.close()
                    f.close()
                    z = None
                if z is None:
                    names.append(f"part-{self.job}-{uuid.uuid4().hex}.zip")
                    f = store.open_output_stream(f"{folder}/{names[-1]}")
                    z = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
                _member(z, rows)
        finally:
            if z is not None:
                z.close()
                f.close()
        return Written(names)

    def commit(self, messages):
        store, folder = _at(self.path)
        with store.open_output_stream(f"{folder}/_archives-{self.job}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        store, folder = _at(self.path)
        for m in messages:
            for n in m.names if m else []:
                store.delete_file(f"{folder}/{n}")


def _sensors(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each sensor's record, one after another."""
    own, rows = None, []
    for row in (r for b in batches for r in b.to_pylist()):
        key = tuple(row[c] for c in NAMED)
        if rows and key != own:
            yield rows
            rows = []
        own = key
        rows.append(row)
    if rows:
        yield rows


def _member(z: zipfile.ZipFile, rows: list[dict]) -> None:
    a = rows[0]
    depths = f"{a['depth_from']:.6f}_{a['depth_to']:.6f}"
    days = "_".join(f"{r['date_time']:%Y%m%d}" for r in (rows[0], rows[-1]))
    name = f"{a['network']}/{a['station']}/{a['network']}_{a['station']}_{a['variable']}_{depths}_{a['sensor']}_{days}{ENDING}"
    head = " ".join(map(str, (a["network"], a["station"], a["latitude"], a["longitude"], a["elevation"], a["depth_from"], a["depth_to"], a["sensor"])))
    value = lambda r: "nan" if r["value"] is None else repr(r["value"])
    minute = lambda t: t.isoformat(" ", "minutes")[:16].replace("-", "/")
    z.writestr(name, "\n".join([head, *(f"{minute(r['date_time'])} {value(r)} {r['flag'] or ''}".rstrip() for r in rows)]) + "\n")


class Archives(DataSource):
    @classmethod
    def name(cls):
        return "stationarchives"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        return ArchiveWriter(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of all members of an archive or a folder of archives. A value that is no number is null, and so is a missing flag; members of other names are passed over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    return spark.read.format("stationarchives").options(**options).load(path)


def write(df: DataFrame, path: str) -> None:
    """Records (the columns of ``SCHEMA``) as archives below ``path``, a member for each sensor's. A member is one task's work, as a sensor's record is of bounded size; times are kept to the minute."""
    spark = df.sparkSession
    spark.dataSource.register(Archives)
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = df.select(*names).repartition(*NAMED).sortWithinPartitions(*NAMED, "date_time")
    rows.write.format("stationarchives").mode("append").save(path)
