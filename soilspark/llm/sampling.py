"""Bounded samples that do not depend on where rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 32


def sampled(df: DataFrame, keys: list[str], size: int, rows: int | None = None) -> DataFrame:
    """At most ``size`` rows of ``df``, those of the smallest hashes of ``keys`` (ties by the keys).

    A bound on the hash, from the number of rows (``rows`` if it is known, as of a table that ``df`` is a part of), leaves about twice as many to sort, so that tasks have
    next to nothing to send however many there are.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(_RANGE))
    n = df.count() if rows is None else rows
    if n > 2 * size:
        df = df.where(h < int(2 * size / n * _RANGE) + 1)
    return df.orderBy(h, *keys).limit(size)
