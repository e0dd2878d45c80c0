"""Registry of the queries that apply operators to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``t("orders")`` or ``t.orders``: the table of that name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    __getattr__ = __call__


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name or f.__name__] = Query(f, sql)
        return f

    return add


def everything() -> dict[str, Query]:
    """All queries, those of every module."""
    from soilspark.plans import q_aggregates, q_composites, q_files, q_joins, q_models, q_pipelines, q_scalars, q_series, q_shapes  # noqa: F401

    return QUERIES
