"""Daily means of unbounded sensor records: an extension of the batch resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(stream: DataFrame, by: list[str], at: str, value: str, late: str = "2 days") -> DataFrame:
    """(by, date, value, n): a day's mean once the watermark has passed it; records later than ``late`` are not counted."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    days = timed.groupBy(*by, F.window(at, "1 day").alias("w")).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return days.select(*by, F.to_date("w.start").alias("date"), value, "n")


def started(out: DataFrame, path: str, checkpoint: str, available_only: bool = True):
    """The running query that appends to Parquet."""
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_only else writer).start()
