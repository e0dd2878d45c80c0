"""Training and test roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequential(df: DataFrame, by: list[str], order: list[str], test: float) -> DataFrame:
    """The first rows of each key train, the rest test."""
    w = Window.partitionBy(*by).orderBy(*order)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = df.withColumn("__p", F.row_number().over(w)).join(sizes, by)
    return rows.withColumn("role", F.when(F.col("__p") <= F.floor(F.col("__n") * (1 - test)), "train").otherwise("test")).drop("__p", "__n")


def by_hash(df: DataFrame, keys: list[str], test: float, seed: int = 42) -> DataFrame:
    """Rows of one key share a role; a seeded hash decides, so the split is the same wherever it runs."""
    return df.withColumn("role", F.when(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < round(test * 10_000), "test").otherwise("train"))


def by_number(df: DataFrame, key: Column, test: float) -> DataFrame:
    """The same for whole-number keys by plain arithmetic."""
    return df.withColumn("role", F.when((key * F.lit(2654435761)) % 1000 < round(test * 1000), "test").otherwise("train"))


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def roles(df: DataFrame, key: str, train: DataFrame, validation: DataFrame) -> DataFrame:
    """Train, Validation, Not in Set, or Unknown for a null key; a key in both sets trains."""
    mark = lambda ids, name: ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    rows = df.join(mark(train, "__t"), key, "left").join(mark(validation, "__v"), key, "left")
    role = F.when(F.col(key).isNull(), "Unknown").when(F.col("__t"), "Train").when(F.col("__v"), "Validation").otherwise("Not in Set")
    return rows.withColumn("role", role).drop("__t", "__v")
