"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.sources.shapes import _at

UNNAMED = "__HIVE_DEFAULT_PARTITION__"  # as Spark's writers call the folder of keys that are null or empty
HELD = 2000  # lines of a file that a task holds


def parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "error").parquet(path)


def csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "error").option("header", True).csv(path)


def by_group(df: DataFrame, key: str, path: str, kind: str = "parquet", spread: int = 8) -> None:
    """A folder for each key. Rows of a key are dealt to at most ``spread`` tasks by a hash, so folders hold few files and a hot key is no single task."""
    writer = df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(spread))).write.mode("overwrite").partitionBy(key)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def _named(rows: DataFrame, path: str, ending: str, head: str | None = None) -> None:
    """Files ``<key>.<ending>`` of the lines of ``rows`` (key, line), whose keys lie side by side in one task each, ``head`` before them.

    Tasks write to folders of their own below one of the job; once all are there, further tasks move the files of those that Spark took to their place, so
    the driver handles a path a task and not a file.
    """
    store, folder = _at(path)
    job = f"{folder}/.{uuid.uuid4().hex}"
    store.create_dir(job, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = _at(path)[0], f"{job}/{uuid.uuid4().hex}"
        at, out, lines = None, None, []

        def flushed() -> None:
            out.write("".join(f"{x}\n" for x in lines).encode())
            lines.clear()

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = key or UNNAMED
                if out is None or name != at:
                    if out is None:
                        store.create_dir(own)
                    else:
                        flushed()
                        out.close()
                    at, out = name, store.open_output_stream(f"{own}/{name}.{ending}")
                    if head is not None:
                        lines.append(head)
                lines.append(line or "")
                if len(lines) == HELD:
                    flushed()
        if out is not None:
            flushed()
            out.close()
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _at(path)[0]
        for batch in batches:
            for own in batch.column(0).to_pylist():
                for x in store.get_file_info(fs.FileSelector(own)):
                    try:
                        store.move(x.path, f"{folder}/{x.base_name}")
                    except FileNotFoundError:  # another run of this task was first
                        if store.get_file_info(f"{folder}/{x.base_name}").type != fs.FileType.File:
                            raise
            yield batch.slice(0, 0)

    try:
        made = rows.mapInArrow(write, "folder string").collect()
        if made:
            rows.sparkSession.createDataFrame(made, "folder string").repartition(len(made)).mapInArrow(move, "folder string").collect()
    finally:
        store.delete_dir(job)


def named_files(df: DataFrame, key: str, path: str) -> None:
    """A CSV file ``<key>.csv`` for each key (``-`` for ``/``), without the key's column. A file is one task's work, so keys are to be of bounded size, like a station's record."""
    rest = [c for c in df.columns if c != key]
    rows = df.select(F.translate(F.col(key).cast("string"), "/", "-").alias("key"), F.to_csv(F.struct(*rest)).alias("line"))
    quoted = lambda c: '"' + c.replace("\\", "\\\\").replace('"', '\\"') + '"' if set(c) & set(',"\n\r') else c
    _named(rows.repartition("key").sortWithinPartitions("key"), path, "csv", ",".join(map(quoted, rest)))


def named_lines(df: DataFrame, key: str, order: str, line: str, path: str, ending: str = "csv") -> None:
    """A text file ``<key>.<ending>`` for each key, its lines in order."""
    rows = df.withColumn(key, F.translate(F.col(key).cast("string"), "/", "-"))
    _named(rows.repartition(F.col(key)).sortWithinPartitions(key, order).select(key, F.col(line).cast("string")), path, ending)


def _documents(fits: DataFrame, key: str) -> DataFrame:
    parameter = lambda p: F.struct(F.col(p).alias("value"), F.col(f"{p}_stderr").alias("stderr"))
    names = ("theta_r", "theta_s", "alpha", "n")
    params = F.create_map(*[x for p in names for x in (F.lit(p), parameter(p))])
    one = F.struct("status", "n_obs", "chi_squared", "reduced_chi_squared", "aic", "bic", params.alias("parameters"))
    docs = fits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("depth_cm").cast("string").alias("k"), one.alias("v")))).alias("d"))
    return docs.select(F.translate(F.col(key).cast("string"), "/", "-").alias(key), F.to_json("d").alias("value")).repartition(F.col(key))


def fit_documents(fits: DataFrame, key: str, path: str) -> None:
    """A folder ``<key>=...`` for each key with its JSON document: depth -> status, statistics and parameters. Depths of one profile are few."""
    _documents(fits, key).write.mode("overwrite").partitionBy(key).text(path)


def named_documents(fits: DataFrame, key: str, path: str) -> None:
    """The same as files ``<key>.json``."""
    _named(_documents(fits, key).sortWithinPartitions(key), path, "json")


def merged_daily(existing: DataFrame, new: DataFrame, by: list[str], value: str) -> DataFrame:
    """Both tables of single observations as one: the mean over all of a key. Means are merged by ``merged_state``."""
    return existing.select(*by, value).unionByName(new.select(*by, value)).groupBy(*by).agg(F.avg(value).alias(value))


def daily_state(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, <column>_sum, <column>_n): what daily means of observations can be merged from."""
    return df.groupBy(*by).agg(*[x for c in columns for x in (F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))])


def merged_state(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Two states as one, by an outer join of their keys: sums and counts add up, a column that only one has (another depth) is kept, and other keys stay as they are.
    Merging the parts of a record in any order gives the state of the whole record."""
    every = existing.unionByName(new, allowMissingColumns=True)
    values = [c for c in every.columns if c not in by]
    return every.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values])


def state_means(state: DataFrame, by: list[str]) -> DataFrame:
    """The daily means of a state; null where nothing was observed."""
    names = [c.removesuffix("_sum") for c in state.columns if c.endswith("_sum")]
    return state.select(*by, *[F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")).alias(c) for c in names])


def missing_only(df: DataFrame, existing: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose keys are not there yet."""
    return df.join(existing.select(*by).distinct(), by, "left_anti")


def geojson(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """(value): a GeoJSON feature a row, points with the other columns as properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))
