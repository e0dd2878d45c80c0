"""New folders that all executors and the driver can reach, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which ``forget`` deletes; only where none is named and everything runs on this machine, below one temporary folder of the session."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("soilspark.scratchDir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="soilspark-")
        spark.conf.set("soilspark.scratchDir", said)
    _made.append(f"{said.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder and read again: its lineage is cut, and a lost executor costs a re-read only."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes what was kept, once the results that read it are written; returns how many folders there were."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
