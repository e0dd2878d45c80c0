"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a
step taken from digests of its name). Shards take turns; each claims the first slot of its order that is
free, until the table is full. So shards differ by at most one slot, and when a shard comes or goes few
slots change hands. A row's key is hashed to a slot; the table is broadcast, and placing is one lookup.

The table has ``slots`` rows whatever the data: 65,537 rows of two integers, about a megabyte. A larger
table than ``MAX_BROADCAST_SLOTS`` is joined by a shuffle instead.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
MAX_BROADCAST_SLOTS = 2_000_000


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def _hashed(text: Column) -> Column:
    """The number that the first 15 hexadecimal digits of a text's MD5 make."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position in ``shards`` of the shard that claimed it. ``slots`` must be a prime of at least as many as shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime of at least as many as the shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    free = slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot (int) and shard (string).

    A null key has its own fixed slot, like any value; equal keys share a slot; all rows stay, repeated ones as well; columns named slot
    or shard are replaced; an empty table stays empty.
    """
    spark: SparkSession = df.sparkSession
    table = lookup_table(shards, slots)
    lookup = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(table)], "slot int, shard string")
    hashed = df.drop("slot", "shard").withColumn("slot", F.pmod(_hashed(F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(slots)).cast("int"))
    return hashed.join(F.broadcast(lookup) if slots <= MAX_BROADCAST_SLOTS else lookup, "slot")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """One folder a shard under ``path``. Rows are spread by slot, so that a shard's rows are written by many tasks."""
    placed(df, key, shards, slots).repartition("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle_sql(table: str, key: str, shards: list[str], slots: int = SLOTS) -> str:
    """DuckDB: the shard of each row of ``table``, the filled table being given as values (a test fills it by another way)."""
    values = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
WITH placed AS (
  SELECT {key}, CAST(CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM {table}
), lookup AS (SELECT [{values}] AS of_slot, [{names}] AS name)
SELECT {key}, slot, name[of_slot[slot + 1] + 1] AS shard FROM placed, lookup
"""
