"""Vectors as array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soilspark.sources import scratch


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def abs_change(v: Column) -> Column:
    """Sum of absolute differences of neighbours."""
    return total(F.zip_with(F.slice(v, 2, F.size(v)), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))


def cosine_pairs(df: DataFrame, key: str, vector: str, by: str, every: int = 50, blocks: int = 64) -> DataFrame:
    """(a, b, cosine) of each vector ``a`` whose key is divisible by ``every`` with each other vector ``b`` of its group.

    Norms are taken once a vector. Vectors are dealt to ``blocks`` of each group by a hash, and the asked ones meet every block, so a group of very many is spread;
    an ``every`` of 1 asks for all pairs, which grows with the square of a group. A null group has no pairs.
    """
    rows = df.select(by, key, vector, F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))
    asked = rows.where(F.col(key) % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("a")
    held = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).alias("b")
    both = asked.join(held, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.block") == F.col("b.block")) & (F.col(f"a.{key}") != F.col(f"b.{key}")))
    return both.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.try_divide(dot(F.col(f"a.{vector}"), F.col(f"b.{vector}")), F.col("a.norm") * F.col("b.norm")).alias("cosine"))


SIDE = 512  # vectors that meet a block at once
BLOCK = 4096  # vectors of a block, at most


def _rows(column: pa.ListArray) -> np.ndarray:
    """Unit vectors, row by row; a vector of length 0 stays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]


def contrastive(df: DataFrame, batch: str, key: str, vector: str, label: str, temperature: float = 0.1, side: int = SIDE) -> DataFrame:
    """(batch, loss, n): over the ``n`` vectors of a batch that share their label with another one the mean of minus the logarithm of what those of its label weigh among all others of the batch.
    A vector weighs the exponential of its cosine over ``temperature``.

    Vectors are dealt by their key to blocks of at least ``side``, which are stored once, a row each; tasks read parts of them side by side (a product without a shuffle), so disk grows with the vectors and not
    with their pairs. Of what a block meets in a task only the sums of each vector are kept, as a largest exponent and a sum relative to it, so nothing overflows and no pair becomes a row; ``side`` vectors meet a
    block at once. The work grows with the square of a batch, as its pairs do. All vectors are of one length; rows with a null are passed over.
    """
    spark = df.sparkSession
    double = df.schema[vector].dataType.elementType.simpleString() == "double"
    kept = F.col(vector) if double else F.col(vector).cast("array<float>")
    rows = df.select(batch, F.col(key).alias("key"), kept.alias("vector"), F.col(label).cast("string").alias("label")).na.drop("any")
    count = F.count("*")
    sizes = rows.groupBy(batch).agg(F.ceil(count / F.greatest(F.lit(side), F.least(F.lit(BLOCK), F.ceil(count / 32)))).cast("int").alias("blocks"))
    own = rows.join(sizes, batch).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in own.select(batch, "key").schema.fields}
    kind = np.float64 if double else np.float32

    def packed(group: pa.Table) -> pa.Table:
        flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group.column(c).combine_chunks())
        return pa.table({batch: group.column(batch)[:1], "own": group.column("own")[:1], "keys": whole("key"), "labels": whole("label"), "x": pa.array([flat.tobytes()], pa.binary())})

    path = scratch.folder(spark, "blocks")
    shape = f"{batch} {kinds[batch]}, own int, keys array<{kinds['key']}>, labels array<string>, x binary"
    own.select(batch, "own", "key", "vector", "label").groupBy(batch, "own").applyInArrow(packed, shape).write.option("parquet.block.size", 16 << 20).parquet(path)
    held = lambda n: spark.read.schema(shape).parquet(path).select(*[F.col(c).alias(f"{n}_{c}") for c in (batch, "own", "keys", "labels", "x")])
    a, b = F.col(f"a_{batch}"), F.col(f"b_{batch}")
    met = held("a").join(held("b"), ~(a < b) & ~(a > b))  # equal, but not a key to be shuffled by
    apart = 2 / temperature > 600  # exponents may lie too far apart to share their largest

    def merged(before: list | None, top: np.ndarray, total: np.ndarray) -> list:
        if before is None:
            return [top, total]
        most = np.maximum(before[0], top)
        base = np.where(np.isfinite(most), most, 0)
        return [most, before[1] * np.exp(before[0] - base) + total * np.exp(top - base)]

    def weighed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest exponents, and all relative to them in place."""
        top = s.max(axis=1, initial=-np.inf)
        s -= np.where(np.isfinite(top), top, 0)[:, None]
        np.exp(s, out=s)
        return top, s

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def told() -> pa.RecordBatch:
            parts = [np.concatenate([sums[at, n][k] for at in sorted(at for at, m in sums if m == "all")]) for n in ("all", "kin") for k in (0, 1)]
            name, keys = now[0], now[2]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), group_type), keys, *map(pa.array, parts)], [batch, "key", "all_top", "all_sum", "kin_top", "kin_sum"])

        for rows in batches:
            for r in range(rows.num_rows):
                of = lambda c: rows.column(c)[r]  # noqa: B023, E731
                at = of(f"a_{batch}").as_py(), of("a_own").as_py()
                if now is None or now[:2] != at:
                    if now is not None:
                        yield told()
                    sums = {}
                    x = np.frombuffer(of("a_x").as_py(), dtype=kind).astype(float).reshape(len(of("a_keys")), -1)
                    now = (*at, of("a_keys").values, x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None], of("a_labels").values)
                keys, x = now[2], now[3]
                y = np.frombuffer(of("b_x").as_py(), dtype=kind).astype(float).reshape(len(of("b_keys")), -1)
                y = y / np.maximum(np.sqrt((y * y).sum(axis=1)), 1e-12)[:, None] / temperature
                code = pa.concat_arrays([now[4], of("b_labels").values]).dictionary_encode().indices.to_numpy()
                mine, other = code[: len(keys)], code[len(keys) :]
                same = at[1] == of("b_own").as_py()  # equal keys are of one block
                left, right = (keys.to_numpy(zero_copy_only=False), of("b_keys").values.to_numpy(zero_copy_only=False)) if same else (None, None)
                for k in range(0, len(keys), side):
                    s = x[k : k + side] @ y.T
                    if same:
                        s[left[k : k + side, None] == right[None, :]] = -np.inf  # itself
                    kin = mine[k : k + side, None] == other[None, :]
                    near = weighed(np.where(kin, s, -np.inf)) if apart else None
                    top, e = weighed(s)
                    sums[k, "all"] = merged(sums.get((k, "all")), top, e.sum(axis=1))
                    if near is None:
                        e *= kin
                        near = top, e
                    sums[k, "kin"] = merged(sums.get((k, "kin")), near[0], near[1].sum(axis=1) * np.isfinite(near[0]))
        if now is not None:
            yield told()

    group_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[batch]]
    parts = met.mapInArrow(work, f"{batch} {kinds[batch]}, key {kinds['key']}, all_top double, all_sum double, kin_top double, kin_sum double")
    each = parts.groupBy(batch, "key").agg(*[F.max(F.when(F.col(f"{n}_sum") > 0, F.col(f"{n}_top"))).alias(f"{n}_most") for n in ("all", "kin")], F.collect_list(F.struct("all_top", "all_sum", "kin_top", "kin_sum")).alias("p"))
    grown = lambda n: F.aggregate("p", F.lit(0.0), lambda t, q: t + F.when(q[f"{n}_sum"] > 0, q[f"{n}_sum"] * F.exp(q[f"{n}_top"] - F.col(f"{n}_most"))).otherwise(0.0))
    each = each.select(batch, "all_most", "kin_most", grown("all").alias("a"), grown("kin").alias("k")).where("k > 0")
    return each.groupBy(batch).agg(F.avg(F.col("all_most") + F.log("a") - F.col("kin_most") - F.log("k")).alias("loss"), F.count("*").alias("n"))


def alignment(df: DataFrame, batch: str, vector: str, other: str) -> DataFrame:
    """(batch, loss): the mean squared difference, over all ordered pairs of different rows of a batch, of the cosines of their vectors and those of their other vectors.

    Sums over pairs of squared products are sums of squares of the products of the matrices of vectors with themselves and each other, so each task adds up three small matrices and no pair is formed.
    """
    rows = df.select(batch, F.col(vector).cast("array<double>").alias("z"), F.col(other).cast("array<double>").alias("s")).na.drop("any")
    kind = rows.schema[batch].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            names = b.column(batch)
            for name in names.unique():
                at = pa.array(np.flatnonzero([x == name for x in names]))
                z, s = _rows(b.column("z").take(at)), _rows(b.column("s").take(at))
                own = (z * z).sum(axis=1) - (s * s).sum(axis=1)  # what a row has with itself: 0 but for vectors of length 0
                parts = [z.T @ z, z.T @ s, s.T @ s, np.array([[float(len(z)), float((own * own).sum())]])]
                before = held.get(name.as_py())
                held[name.as_py()] = parts if before is None else [p + q for p, q in zip(before, parts, strict=True)]
        rows = [(name, k, p.ravel().tolist()) for name, parts in held.items() for k, p in enumerate(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], names_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], [batch, "k", "m"])

    names_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    cells = rows.mapInArrow(summed, f"{batch} {kind}, k int, m array<double>").select(batch, "k", F.posexplode("m").alias("at", "v"))
    total = cells.groupBy(batch, "k", "at").agg(F.sum("v").alias("v"))
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("v") * F.col("v")))
    last = lambda at: F.sum(F.when((F.col("k") == 3) & (F.col("at") == at), F.col("v")))
    sums = total.groupBy(batch).agg((of(0) - 2 * of(1) + of(2) - last(1)).alias("square"), last(0).alias("n"))
    return sums.select(batch, F.try_divide("square", F.col("n") * (F.col("n") - 1)).alias("loss"))
