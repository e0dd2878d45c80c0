"""States kept between runs and merged by whoever comes, one version after another.

A state is a table of sums and counts by key, dealt to buckets by a hash of the key. Below its folder lie ``data``, a new folder for each merge, and ``versions``: version n is a small JSON
file that names the folders of each bucket and the batches that are in. A merge reads the buckets that its batch touches, writes them anew beside the old ones, and then puts the next version's file
in place, whole and only if nobody else has. Who comes second takes the new version and merges the buckets that it changed once more, so no batch is lost; a batch that is in already
is not merged again. Until its version is in place a merge changes nothing that is read, so a crash leaves the old version and some folders that ``cleared`` deletes.

Putting a file in place needs a file system whose rename (or, on a mounted folder, link) fails where a file is already: HDFS and POSIX do, plain object stores don't.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soilspark.sources.sinks import merged_state

BUCKETS = 32
ATTEMPTS = 50


@dataclass(frozen=True)
class Version:
    number: int = 0
    by: list[str] = field(default_factory=list)
    buckets: int = BUCKETS
    folders: dict[str, str] = field(default_factory=dict)  # bucket -> folder below data
    batches: list[str] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another merge has put this version in place."""


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions that are in place, ascending."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version of that number, else the latest; number 0 if there is none."""
    known = versions(spark, root)
    if not known and number is None:
        return Version()
    n = known[-1] if number is None else number
    return Version(**json.loads(spark.read.option("wholetext", True).text(f"{root}/versions/{n:012d}.json").first()["value"]))


def _placed(spark: SparkSession, root: str, new: Version) -> None:
    """Puts the file of a version in place as a whole, or raises ``Conflict``."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/versions"))
    before, to = f"{root}/versions/.{uuid.uuid4().hex}", f"{root}/versions/{new.number:012d}.json"
    out = fs.create(path(before), False)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace what is there
            local = lambda p: path(p).toUri().getPath()
            try:
                os.link(local(before), local(to))
            except FileExistsError:
                raise Conflict(to) from None
        elif fs.exists(path(to)) or not fs.rename(path(before), path(to)):
            raise Conflict(to)
    finally:
        fs.delete(path(before), False)


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The state of a version, else of the latest."""
    v = version(spark, root, number)
    if not v.number:
        raise FileNotFoundError(f"no state in {root}")
    return _of(spark, root, v, sorted(v.folders)).drop("__bucket")


def _of(spark: SparkSession, root: str, v: Version, buckets: list[str]) -> DataFrame:
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{root}/data/{v.folders[b]}/__bucket={b}" for b in buckets])
    return rows.withColumn("__bucket", bucket_of(v.by, v.buckets))


def merge(new: DataFrame, root: str, by: list[str], batch: str | None = None, buckets: int = BUCKETS) -> int:
    """Merges a batch, a state by ``by`` (``daily_state``), into the one below ``root`` and returns the version that has it.

    Sums and counts add up, columns that only one side has are kept. A ``batch`` that is in already changes nothing. The number of buckets is that of the first version.
    """
    spark = new.sparkSession
    done: dict[str, tuple[str | None, str]] = {}  # bucket -> the folder it was merged with, and the one it is in now
    for _ in range(ATTEMPTS):
        now = version(spark, root)
        if batch is not None and batch in now.batches:
            return now.number
        if now.number and now.by != list(by):
            raise ValueError(f"the state is by {now.by}")
        n = now.buckets if now.number else buckets
        rows = new.withColumn("__bucket", bucket_of(by, n))
        touched = [str(r["__bucket"]) for r in rows.select("__bucket").distinct().collect()]
        stale = [b for b in touched if b not in done or done[b][0] != now.folders.get(b)]
        if stale:
            mine = rows.where(F.col("__bucket").isin([int(b) for b in stale]))
            there = [b for b in stale if b in now.folders]
            own = [*by, "__bucket"]
            merged = merged_state(_of(spark, root, now, there), mine, own) if there else mine
            folder = uuid.uuid4().hex
            merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{root}/data/{folder}")
            done |= {b: (now.folders.get(b), folder) for b in stale}
        after = Version(now.number + 1, list(by), n, now.folders | {b: done[b][1] for b in touched}, [*now.batches, *([batch] if batch is not None else [])])
        try:
            _placed(spark, root, after)
        except Conflict:
            continue
        return after.number
    raise Conflict(f"{ATTEMPTS} attempts to change {root}")


def cleared(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the last ``keep`` versions and the folders that these don't name; returns how many folders went. Only while nobody merges or reads older versions."""
    fs, path = _fs(spark, root)
    known = versions(spark, root)
    held = {f for n in known[-keep:] for f in version(spark, root, n).folders.values()}
    for n in known[:-keep]:
        fs.delete(path(f"{root}/versions/{n:012d}.json"), False)
    gone = [s.getPath() for s in (fs.listStatus(path(f"{root}/data")) if fs.exists(path(f"{root}/data")) else []) if s.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
