"""Shared storage for intermediate tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir`` of the session.

    Only where none is named and everything runs on this machine, as in tests, is a temporary folder made.
    """
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("soilspark.sharedDir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="soilspark-")
        spark.conf.set("soilspark.sharedDir", said)
    return said.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``forget`` deletes."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


_BATCH, _READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
ROW_GROUP = 16 << 20  # bytes that a task holds of large rows before it writes them, and reads of them at once


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut, and a lost executor costs a re-read only.

    ``batch_rows``: while this is written, Python is handed and Parquet decoded so many rows at a time at most, for rows that are large; a decoded batch is 4,096 rows else, whatever their size.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    if not batch_rows:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = {c: spark.conf.get(c) for c in (_BATCH, _READ)}
    try:
        for c in before:
            spark.conf.set(c, str(batch_rows))
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the intermediate tables and archives of this process, once the results that read them are written; returns how many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
