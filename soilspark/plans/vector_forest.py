"""Regression forests whose leaves hold a vector of targets, grown level by level from histograms that Spark adds up.

A table is binned once and kept as Parquet: a feature's cuts lie between its values where these are few, else at quantiles of all rows. At each level every task runs its rows down the
trees grown so far and sums, for each open node, feature and bin, the weights and each target; sums of tasks meet by tree, where the best split of each node is taken: the one
by which the squared errors of all targets together fall most (ties: the first feature, the lowest cut). Open nodes are taken in parts of ``HELD`` bytes of sums, so a
task's memory does not grow with trees, depth or features. The driver holds the trees, whose size the parameters bound.

Where the bins of all features make at most ``CELLS`` combinations, whose sums of all trees are within ``HELD``, all that a tree can learn of the rows are the sums of each combination. Then rows are read once, for all levels: tasks sum them by tree and
combination, sums meet by tree, and a tree is grown from its own. Trees are the same either way but for the order in which numbers are added. Predictions are looked up by the combination of intervals likewise.

Every tree has its own weights of rows, Poisson by a hash of the row's number and the tree's. Rows with an unknown target or feature do not train, and have no prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soilspark.plans.assemble import missing_features
from soilspark.sources import scratch

BINS = 32
HELD = 48 << 20  # bytes of sums that a task holds at once
CELLS = 1 << 15  # combinations of bins up to which rows are summed by them, in one pass
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# fixed values: the Poisson distribution of mean 1, added up
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over heap numbers (the children of i are 2 i + 1 and 2 i + 2): feature (-1: leaf), cut (right if above), values by target, falls by target."""

    features: list[str]
    targets: list[str]
    feature: np.ndarray  # trees, nodes
    cut: np.ndarray
    value: np.ndarray  # trees, nodes, targets
    fall: np.ndarray  # trees, nodes, targets: by how much a split lowers each target's squared errors

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """(rows, targets): means over the trees."""
        if "_held" not in self.__dict__:
            edges = [np.unique(self.cut[self.feature == f]) for f in range(len(self.features))]
            table = None
            if np.prod([len(e) + 1.0 for e in edges]) <= CELLS:  # a value of each interval stands for it
                table = self._walked(np.stack([g.ravel() for g in np.meshgrid(*[np.append(e, np.inf) for e in edges], indexing="ij")], axis=1))
            object.__setattr__(self, "_held", (edges, table))
        edges, table = self.__dict__["_held"]
        if table is None:
            return self._walked(x)
        at = np.zeros(len(x), dtype=np.int64)
        for f, e in enumerate(edges):
            at = at * (len(e) + 1) + np.searchsorted(e, x[:, f], side="left")
        return table[at]

    def _walked(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.targets)))
        row = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                right = x[row, np.maximum(f[node], 0)] > c[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += v[node]
        return out / len(self.feature)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_weights(number: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    own = np.uint64((seed * 1_000_003 + tree + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    u = (_mixed((number.astype(np.uint64) + np.uint64(1)) * _GOLD + own) >> np.uint64(11)) * 2.0**-53
    out = np.zeros(len(number), dtype=np.int8)
    for edge in _POISSON:
        out += u > edge
    return out


def cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Where each feature may be cut: between all its values if there are at most ``bins``, else at quantiles (to 1 in 20 bins of all rows)."""
    kinds = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in features]).first()
    few = [c for c in features if kinds[c] <= 2 * bins]
    held = {c: sorted(float(r[0]) for r in df.select(F.col(c).cast("double")).distinct().limit(2 * bins + bins).collect()) for c in few}
    rest = [c for c in features if len(held.get(c, [None] * (bins + 1))) > bins]
    at = [k / bins for k in range(1, bins)]
    quantiles = dict(zip(rest, df.select(*[F.col(c).cast("double").alias(c) for c in rest]).approxQuantile(rest, at, 1 / (20 * bins)), strict=True)) if rest else {}
    out = []
    for c in features:
        v = np.array(held[c] if c not in quantiles else sorted(set(quantiles[c])))
        out.append((v[1:] + v[:-1]) / 2 if c not in quantiles else v)
    return out


def _binned(df: DataFrame, features: list[str], targets: list[str], edges: list[np.ndarray], weight: str | None, kept: bool = True) -> DataFrame:
    spark = df.sparkSession
    known = df.na.drop("any", subset=[*targets, *features])
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = [F.col(c).cast("double").alias(f"{kind}{k}") for kind, names in (("x", features), ("y", targets)) for k, c in enumerate(names)]
    each = known.select(*numbered, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array(np.searchsorted(e, batch.column(f"x{k}").to_numpy(), side="left").astype(np.int16)) for k, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([*cols, *[batch.column(f"y{k}") for k in range(len(targets))], batch.column("w")], [*[f"b{k}" for k in range(len(edges))], *[f"y{k}" for k in range(len(targets))], "w"])

    shape = ", ".join([f"b{k} short" for k in range(len(features))] + [f"y{k} double" for k in range(len(targets))] + ["w double"])
    # the work on a row is far beyond reading it, so rows are dealt to all cores, however few files they come from
    dealt = each.mapInArrow(run, shape).withColumn("number", F.monotonically_increasing_id()).repartition(tasks, "number")
    if not kept:
        return dealt
    path = scratch.folder(spark, "binned")
    dealt.write.parquet(path)
    return spark.read.schema(shape + ", number long").parquet(path)


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batches put together to about ``rows`` rows, as every tree's work on a batch has a cost of its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best(sums: np.ndarray, whole: np.ndarray, at: np.ndarray, least: float) -> tuple | None:
    """(gain, feature, bin, sums left, sums right, falls) of the best split of a node with ``sums`` (weights and targets, bins of all features), None where none lowers the errors."""
    best = None
    for f in range(len(at) - 1):
        left = np.cumsum(sums[:, at[f] : at[f + 1]], axis=1)[:, :-1]
        right = whole[:, None] - left
        able = (left[0] >= least) & (right[0] >= least) & (left[0] > 0) & (right[0] > 0)
        if not able.any():
            continue
        nl, nr = np.where(able, left[0], 1.0), np.where(able, right[0], 1.0)
        fall = left[1:] ** 2 / nl + right[1:] ** 2 / nr - (whole[1:] ** 2 / whole[0])[:, None]
        gain = np.where(able, fall.sum(axis=0), -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > 1e-9 * max(1.0, float((whole[1:] ** 2).sum() / whole[0])) and (best is None or gain[b] > best[0] * (1 + 1e-12)):
            best = gain[b], f, b, left[:, b], right[:, b], fall[:, b]
    return best


def _from_cells(rows: DataFrame, sizes: list[int], k: int, trees: int, depth: int, seed: int, least: float) -> list:
    """(tree, node, feature, bin, sums left, sums right, falls) of all nodes that were open at any level, from one pass over ``rows``."""
    cells, at = int(np.prod(sizes)), np.append(0, np.cumsum(sizes))
    width = cells * (k + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, k + 1, cells))
        for batch in _larger(batches, 20_000):
            x = np.zeros(batch.num_rows, dtype=np.int64)
            for f, size in enumerate(sizes):
                x = x * size + batch.column(f"b{f}").to_numpy()
            w0, number = batch.column("w").to_numpy(), batch.column("number").to_numpy()
            values = [w0, *[w0 * batch.column(f"y{j}").to_numpy() for j in range(k)]]
            for t in range(trees):
                w = row_weights(number, t, seed)
                for j, v in enumerate(values):
                    sums[t, j] += np.bincount(x, weights=v * w, minlength=cells)
        for t in range(trees):
            whole = pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(sums[t].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), whole], ["tree", "sums"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, width)
            for t, v in zip(batch.column("tree").to_pylist(), flat, strict=True):
                if t in total:
                    total[t] += v
                else:
                    total[t] = v.copy()
        out = []
        for t, v in sorted(total.items()):
            whole_table = v.reshape(k + 1, *sizes)
            nodes = [(0, np.array([[0, size] for size in sizes]))]  # with the bins that reach them
            for _ in range(depth):
                after = []
                for n, box in nodes:
                    here = whole_table[(slice(None), *[slice(a, z) for a, z in box])]
                    sums = np.zeros((k + 1, int(at[-1])))
                    for f, (a, z) in enumerate(box):
                        sums[:, at[f] + a : at[f] + z] = here.sum(axis=tuple(1 + g for g in range(len(sizes)) if g != f))
                    if not sums[0].any():
                        continue
                    whole = sums[:, at[0] : at[1]].sum(axis=1)
                    best = _best(sums, whole, at, least)
                    if best is None:
                        out.append((t, n, -1, -1, whole.tolist(), None, None))
                        continue
                    _, f, b, left, right, fall = best
                    out.append((t, n, f, b, left.tolist(), right.tolist(), fall.tolist()))
                    for child, side in ((2 * n + 1, 1), (2 * n + 2, 0)):
                        own = box.copy()
                        own[f, side] = b + 1
                        after.append((child, own))
                nodes = after
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["tree", "node", "feature", "bin", "left", "right", "fall"])

    spark = rows.sparkSession
    shared = rows.mapInArrow(summed, "tree int, sums array<double>").repartition(2 * spark.sparkContext.defaultParallelism, "tree")
    return shared.mapInArrow(grow, "tree int, node int, feature int, bin int, left array<double>, right array<double>, fall array<double>").collect()


def _level(rows: DataFrame, open_nodes: dict[int, list[int]], depth: int, feature: np.ndarray, bin_: np.ndarray, sizes: list[int], k: int, seed: int, least: float) -> list:
    """(tree, node, feature, bin, sums left, sums right) of the best split of each open node, None where none lowers the errors; sums are of weights and targets."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((open_nodes, feature, bin_))
    at = np.append(0, np.cumsum(sizes))
    width = int(at[-1]) * (k + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, feats, bins = held.value
        sums = {t: np.zeros((k + 1, len(ns), int(at[-1]))) for t, ns in nodes.items()}
        for batch in _larger(batches):
            x = np.stack([batch.column(f"b{f}").to_numpy() for f in range(len(sizes))]).astype(np.int64)
            y = [batch.column(f"y{j}").to_numpy() for j in range(k)]
            w0, number = batch.column("w").to_numpy(), batch.column("number").to_numpy()
            for t, ns in nodes.items():
                w = row_weights(number, t, seed)
                live = np.flatnonzero(w)
                node = np.zeros(len(live), dtype=np.int64)
                for _ in range(depth):
                    f = feats[t][node]
                    on = f >= 0
                    live, node, f = live[on], node[on], f[on]
                    node = 2 * node + 1 + (x[f, live] > bins[t][node])
                place = np.full(1 << (depth + 1), -1)
                place[ns] = np.arange(len(ns))
                p = place[node]
                live, p = live[p >= 0], p[p >= 0]
                wt = w[live] * w0[live]
                values = [wt, *[wt * v[live] for v in y]]
                for f, size in enumerate(sizes):
                    index = p * size + x[f, live]
                    for j, v in enumerate(values):
                        sums[t][j, :, at[f] : at[f + 1]] += np.bincount(index, weights=v, minlength=len(ns) * size).reshape(len(ns), size)
        for t, ns in nodes.items():
            some = np.flatnonzero(sums[t][0].any(axis=1))
            flat = sums[t].transpose(1, 0, 2)[some].reshape(len(some), width)
            own = [pa.array(np.full(len(some), t, dtype=np.int32)), pa.array(np.array(ns, dtype=np.int32)[some])]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))], ["tree", "node", "sums"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            flat = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, width)
            for t, n, v in zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist(), flat, strict=True):
                if (t, n) in total:
                    total[t, n] += v
                else:
                    total[t, n] = v.copy()
        out = []
        for (t, n), v in sorted(total.items()):
            sums = v.reshape(k + 1, int(at[-1]))
            whole = sums[:, at[0] : at[1]].sum(axis=1)
            best = _best(sums, whole, at, least)
            out.append((t, n, *((best[1], best[2], best[3].tolist(), best[4].tolist(), best[5].tolist()) if best else (-1, -1, whole.tolist(), None, None))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["tree", "node", "feature", "bin", "left", "right", "fall"])

    shared = rows.mapInArrow(summed, "tree int, node int, sums array<double>").repartition(2 * spark.sparkContext.defaultParallelism, "tree", "node")
    return shared.mapInArrow(split, "tree int, node int, feature int, bin int, left array<double>, right array<double>, fall array<double>").collect()


def grown(df: DataFrame, targets: list[str], features: list[str], trees: int = 250, depth: int = 8, bins: int = BINS, least: float = 1.0, seed: int = 42, weight: str | None = None) -> Forest:
    """A forest of all ``targets`` together, every split over all ``features``. ``least`` is the weight that either side of a split keeps."""
    edges = cuts(df.na.drop("any", subset=[*targets, *features]), features, bins)
    sizes, k, nodes = [len(e) + 1 for e in edges], len(targets), (2 << depth) - 1
    cells = np.prod(np.array(sizes, dtype=float))
    whole = cells <= CELLS and 8 * trees * (k + 1) * cells <= HELD
    rows = _binned(df, features, targets, edges, weight, kept=not whole)
    feature, bin_ = np.full((trees, nodes), -1, dtype=np.int32), np.zeros((trees, nodes), dtype=np.int32)
    value, fall = np.full((trees, nodes, k), np.nan), np.zeros((trees, nodes, k))

    def took(found: list) -> list[tuple[int, int]]:
        after = []
        for r in found:
            t, n = r["tree"], r["node"]
            left = np.array(r["left"])
            if r["feature"] < 0:
                value[t, n] = left[1:] / left[0]
                continue
            right = np.array(r["right"])
            value[t, n] = (left + right)[1:] / (left + right)[0]
            feature[t, n], bin_[t, n], fall[t, n] = r["feature"], r["bin"], r["fall"]
            for child, s in ((2 * n + 1, left), (2 * n + 2, right)):
                value[t, child] = s[1:] / s[0]
                after.append((t, child))
        return after

    if whole:
        took(sorted(_from_cells(rows, sizes, k, trees, depth, seed, least), key=lambda r: (r["tree"], r["node"])))
    open_: list[tuple[int, int]] = [] if whole else [(t, 0) for t in range(trees)]
    a_time = max(1, HELD // (8 * sum(sizes) * (k + 1)))
    for level in range(depth):
        after = []
        for at in range(0, len(open_), a_time):
            part: dict[int, list[int]] = {}
            for t, n in open_[at : at + a_time]:
                part.setdefault(t, []).append(n)
            after += took(_level(rows, part, level, feature, bin_, sizes, k, seed, least))
        open_ = sorted(after)
    if np.isnan(value[:, 0]).any():
        raise ValueError("no row has all targets and features")
    cut = np.zeros((trees, nodes))
    for f, e in enumerate(edges):
        here = feature == f
        cut[here] = e[bin_[here]]
    return Forest(features, targets, feature, cut, value, fall)


def inferred(forest: Forest, df: DataFrame) -> DataFrame:
    """``df`` with ``<target>_pred`` of each target, after the check that it has every feature; null where a feature is unknown."""
    lacking = missing_features(forest.features, df)
    if lacking:
        raise ValueError(f"the table lacks the features {', '.join(lacking)}")
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("array<double>")
    def predicted(*x: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(dtype=float) for c in x], axis=1)
        known = np.isfinite(values).all(axis=1)
        out = np.full((len(values), len(held.value.targets)), np.nan)
        out[known] = held.value.predicted(values[known])
        return pd.Series(list(out))

    p = df.withColumn("__p", predicted(*[F.col(c).cast("double") for c in forest.features]))
    return p.withColumns({f"{y}_pred": F.nanvl(F.get("__p", F.lit(k)), F.lit(None)) for k, y in enumerate(forest.targets)}).drop("__p")


def importances(forest: Forest, spark: SparkSession) -> DataFrame:
    """(target, feature, importance): each feature's share of what the splits of a tree lower a target's squared errors by, averaged over trees; target ``all`` takes them together."""
    rows = []
    for name, fall in [("all", forest.fall.sum(axis=2)), *[(y, forest.fall[..., k]) for k, y in enumerate(forest.targets)]]:
        by = np.stack([np.where(forest.feature == f, fall, 0).sum(axis=1) for f in range(len(forest.features))], axis=1)
        total = by.sum(axis=1, keepdims=True)
        share = (by / np.where(total > 0, total, 1)).mean(axis=0)
        rows += [(name, f, float(s)) for f, s in zip(forest.features, share, strict=True)]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def saved(forest: Forest, spark: SparkSession, path: str) -> None:
    """The forest's nodes as Parquet in a new folder, with the lists of features and targets."""
    t, n = np.nonzero(~np.isnan(forest.value[..., 0]))
    f = forest.feature[t, n]
    table = pd.DataFrame({"tree": t, "node": n, "feature": f, "cut": forest.cut[t, n], "value": forest.value[t, n].tolist(), "fall": forest.fall[t, n].tolist()})
    spark.createDataFrame(table, "tree int, node int, feature int, cut double, value array<double>, fall array<double>").coalesce(1).write.parquet(f"{path}/nodes")
    spark.createDataFrame([(forest.features, forest.targets, *forest.feature.shape)], "features array<string>, targets array<string>, trees int, nodes int").write.json(f"{path}/names")


def loaded(spark: SparkSession, path: str) -> Forest:
    """What ``saved`` wrote."""
    names = spark.read.schema("features array<string>, targets array<string>, trees int, nodes int").json(f"{path}/names").first()
    shape, k = (names["trees"], names["nodes"]), len(names["targets"])
    forest = Forest(names["features"], names["targets"], np.full(shape, -1, dtype=np.int32), np.zeros(shape), np.full((*shape, k), np.nan), np.zeros((*shape, k)))
    table = spark.read.parquet(f"{path}/nodes").toPandas()
    at = table["tree"].to_numpy(), table["node"].to_numpy()
    forest.feature[at], forest.cut[at] = table["feature"].to_numpy(), table["cut"].to_numpy()
    forest.value[at], forest.fall[at] = np.stack(table["value"]), np.stack(table["fall"])
    return forest


def grown_levels(df: DataFrame, level: str, targets: list[str], features: list[str], least_rows: int = 10, **more) -> dict:
    """level -> forest, for each of the few levels with ``least_rows`` rows of all targets and features."""
    known = df.na.drop("any", subset=[level, *targets, *features]).groupBy(level).count().where(F.col("count") >= least_rows)
    return {r[level]: grown(df.where(F.col(level) == r[level]), targets, features, **more) for r in known.orderBy(level).collect()}


def inferred_levels(forests: dict, df: DataFrame, level: str) -> DataFrame:
    """Every row of a level that has a forest, with ``<target>_pred`` by it; a scan of its level's rows each."""
    out = None
    for name, forest in forests.items():
        one = inferred(forest, df.where(F.col(level) == name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no level has a forest")
    return out
