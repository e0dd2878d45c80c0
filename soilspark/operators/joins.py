"""Joins with the guarantees that assembly needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each key, the first by ``order`` (which must not tie)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def left_first(left: DataFrame, right: DataFrame, on: list[str], order: list) -> DataFrame:
    """Left join with the first right row of each key, so left rows never multiply."""
    return left.join(first_row(right, on, order), on, "left")


def left_keeping(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join; columns of the left side that the right one has too are replaced."""
    both = [c for c in right.columns if c in left.columns and c not in on]
    return left.drop(*both).join(right, on, "left")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    twice = right.groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the right side repeats the key {twice[0].asDict()}")
    return left.join(right, on, "left")


def band_join(df: DataFrame, bands: DataFrame, value: Column, lo: str = "lo", hi: str = "hi", how: str = "inner") -> DataFrame:
    """Rows with the band whose half-open bounds hold their value. ``bands`` is a dimension table of a few rows."""
    return df.join(F.broadcast(bands), (value >= F.col(lo)) & (value < F.col(hi)), how)


def nearest_join(df: DataFrame, centres: DataFrame, value: Column, centre: str, tie: str) -> DataFrame:
    """Rows with the columns of the centre nearest to their value, the smaller ``tie`` of two; null where the value is.

    ``centres`` is a dimension table of a few rows: it travels as one array beside each row, so rows are neither multiplied nor shuffled.
    """
    names = [centre, tie, *[c for c in centres.columns if c not in (centre, tie)]]
    table = centres.agg(F.collect_list(F.struct(*names)).alias("__c"))
    apart = F.transform("__c", lambda c: F.struct(F.abs(value - c[centre]).alias("d"), c[tie].alias("t"), c.alias("c")))
    rows = df.join(F.broadcast(table)).withColumn("__b", F.when(value.isNotNull(), F.array_min(apart)["c"])).drop("__c")
    return rows.select(*df.columns, *[F.col(f"__b.{c}").alias(c) for c in names])


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def in_all(ids: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table holds."""
    out = ids[0].select(key).distinct()
    for df in ids[1:]:
        out = out.join(df.select(key), key, "left_semi")
    return out


def at_least(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of keys that have ``n`` rows or more; counted by partial aggregation, then a semi join."""
    return df.join(df.groupBy(*by).count().where(F.col("count") >= n).select(*by), by, "left_semi")
