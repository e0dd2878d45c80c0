"""Wide to long and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value", keep_null: bool = True) -> DataFrame:
    out = df.unpivot(ids, values, name, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def pivot_mean(df: DataFrame, ids: list[str], name: str, keys: list, value: str) -> DataFrame:
    return df.groupBy(*ids).pivot(name, keys).agg(F.avg(value))


def pivot_first(df: DataFrame, ids: list[str], name: str, keys: list, values: list[str], order: str) -> DataFrame:
    """For each key the first non-null of several values by ``order``, in columns ``<key>_<value>``."""
    return df.groupBy(*ids).pivot(name, keys).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def paired_columns(df: DataFrame, ids: list[str], pairs: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """Columns that belong together in twos become rows; pairs with a null go."""
    each = F.explode(F.array(*[F.struct(F.col(a).cast("double").alias(names[0]), F.col(b).cast("double").alias(names[1])) for a, b in pairs])).alias("p")
    return df.select(*ids, each).select(*ids, "p.*").where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def named_columns(df: DataFrame, ids: list[str], pattern: str, groups: list[str], pivot: str, keys: list[str], least: int = 0) -> DataFrame:
    """Columns whose names carry several parts (``pattern`` with a group for each of ``groups``) become a row for each combination of the parts other than
    ``pivot``, with a column for each of ``keys``. Rows with fewer than ``least`` known values go."""
    found = [c for c in df.columns if re.match(pattern, c)]
    long = df.unpivot(ids, found, "__name", "__value").where("__value is not null")
    long = long.select(*ids, "__value", *[F.regexp_extract("__name", pattern, k).alias(g) for k, g in enumerate(groups, 1)])
    rest = [g for g in groups if g != pivot]
    wide = long.groupBy(*ids, *rest).pivot(pivot, keys).agg(F.avg("__value"))
    return wide.where(sum(F.col(k).isNotNull().cast("int") for k in keys) >= least) if least else wide


def one_hot(df: DataFrame, column: str, categories: list, prefix: str | None = None) -> DataFrame:
    """A 0/1 column for each of a fixed list of categories; others have none."""
    return df.withColumns({f"{prefix or column}_{k}": F.coalesce((F.col(column) == k).cast("int"), F.lit(0)) for k in categories})


def vector_columns(df: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    width = len(str(n - 1))
    return df.select("*", *[F.get(column, F.lit(i)).alias(f"{prefix}{i:0{width}d}") for i in range(n)]).drop(column)


def columns_vector(df: DataFrame, names: list[str], column: str) -> DataFrame:
    return df.withColumn(column, F.array(*names)).drop(*names)


def union_filled(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_common(frames: list[DataFrame]) -> DataFrame:
    """All rows of the columns that every table has."""
    names = [c for c in frames[0].columns if all(c in df.columns for df in frames)]
    out = frames[0].select(*names)
    for df in frames[1:]:
        out = out.unionByName(df.select(*names))
    return out


def property_stack(df: DataFrame, by: list[str], variable: str, top: str, bottom: str, value: str, variables: list[str], depths: list[tuple[int, int]], prefix: str = "polaris") -> DataFrame:
    """A row for each key with a column ``<prefix>_<variable>_<top>_<bottom>cm`` for each variable and depth: the mean of its values, null without any."""
    names = [f"{v}_{a}_{z}cm" for v in variables for a, z in depths]
    name = F.concat(F.col(variable), F.lit("_"), F.col(top).cast("int"), F.lit("_"), F.col(bottom).cast("int"), F.lit("cm"))
    wide = df.withColumn("__name", name).groupBy(*by).pivot("__name", names).agg(F.avg(value))
    return wide.select(*by, *[F.col(n).alias(f"{prefix}_{n}") for n in names])
