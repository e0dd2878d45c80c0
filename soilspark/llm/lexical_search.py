"""Ranked lexical search over trees of documents that share the beginnings of their term vectors.

A document's score for an item is the sum over the item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)): tf is how often the term occurs in the
document, w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 25 + (75 n N) div L, with n the document's terms, N and L documents with a term and all their
terms, df the documents that hold the term. All but the logarithm is exact in 64 bits.

1. Every text is split once; kept are n and the document's vector restricted to terms of items, as Parquet. N, L and df are counted over all documents.
2. A task turns each ``BLOCK`` of vectors into a tree: terms are ordered by frequency, most frequent first, so vectors share paths; a node knows the largest tf of
   each term and the smallest m below it. Nodes of at most ``LEAF`` documents, and small neighbours together, are leaves.
3. For each item the tree is searched depth-first, the child of the largest bound first. A subtree is left out only if its bound cannot come before the ``top`` documents
   that the task has found so far, so nothing is lost. The best of all tasks are ranked by item.

Each row of ``docs`` is a document of its own, whatever its id (an integer); null text has no terms; equal scores go by ascending id, rows without id last. Items of the same
id are one item of all their terms; items without id or terms have no rows. Items are looked up in the tasks in groups of some ``MAX_TERMS`` terms, a pass over the texts each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soilspark.llm.storage import stored

TOP = 10
BLOCK = 1 << 14  # documents of a tree
LEAF = 128
MAX_TERMS = 1_000_000  # term occurrences of the items that are searched in a pass
SLICE = 1 << 20
_SALTS = 64
_LAST = np.iinfo(np.int64).max

# fixed values: what ends a term (ASCII but digits and letters), as a table that turns it into spaces and lowers A-Z
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    text, at = text.translate(_TERMS), 0
    while len(text) - at > SLICE:
        to = text.rfind(b" ", at, at + SLICE) + 1
        if to <= at:
            to = text.find(b" ", at + SLICE) + 1 or len(text)
        yield text[at:to].split()
        at = to
    yield text[at:].split()


def _item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each item holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[w for part in _terms(t.as_py() or b"") for w in part] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(held, pa.list_(pa.binary()))], ["item_id", "term"])

    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {kind}, term array<binary>").select("item_id", F.explode("term").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("q"))


def _vectors(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): the number of a document's terms, and those among ``ids`` with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.get
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                count, found = 0, []
                for words in _terms(text.as_py()):
                    count += len(words)
                    got = np.fromiter(map(of, words, repeat(-1)), dtype=np.int32, count=len(words))
                    found.append(got[got >= 0])
                t, c = np.unique(np.concatenate(found), return_counts=True)
                n.append(count)
                ends.append(ends[-1] + len(t))
                terms.append(t)
                tfs.append(c)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>").where("n > 0")


def lengths(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms, among ``count`` documents of ``total`` terms."""
    if 75 * int(n.max(initial=0)) * count >= 1 << 62:
        return np.array([25 + 75 * int(x) * count // total for x in n], dtype=np.int64)
    return 25 + 75 * n.astype(np.int64) * count // total


def weight(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence counts, before the term's own weight; it rises with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Documents by their vectors. Terms are numbered by frequency, the most frequent first, and ascend within a document; none is without terms."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, leaf: int = LEAF):
        begin = np.cumsum(sizes) - sizes
        key = term.astype(">u4")
        order = np.array(sorted(range(len(ids)), key=[key[b : b + s].tobytes() for b, s in zip(begin, sizes, strict=True)].__getitem__), dtype=np.int64)
        self.ids, self.m, self.size = ids[order], m[order], sizes[order]
        self.at = np.append(0, np.cumsum(self.size))
        entry = np.repeat(begin[order] - self.at[:-1], self.size) + np.arange(self.at[-1])
        self.term, self.tf = term[entry], tf[entry]
        self.gain = weight(self.tf, np.repeat(self.m, self.size))
        self.kids: list[tuple[int, int]] = [(0, 0)]  # of each node the range of its children; none for a leaf
        self.range = [(0, len(ids))]
        open_ = [(0, 0)]
        while open_:
            node, depth = open_.pop()
            parts, depth = self._parts(*self.range[node], depth, leaf)
            if len(parts) < 2:
                continue
            first = len(self.range)
            self.kids[node] = (first, first + len(parts))
            self.range += parts
            self.kids += [(0, 0)] * len(parts)
            open_ += [(first + k, depth) for k, (lo, hi) in enumerate(parts) if hi - lo > leaf]
        self._bounds()

    def _parts(self, lo: int, hi: int, depth: int, leaf: int) -> tuple[list[tuple[int, int]], int]:
        """The children of a node: by the first term at which its documents part ways, small neighbours together."""
        cuts = np.zeros(0, dtype=np.int64)
        while not len(cuts) and hi - lo > leaf:
            longer = self.size[lo:hi] > depth
            if not longer.any():
                break
            here = np.where(longer, self.term[np.minimum(self.at[lo:hi] + depth, len(self.term) - 1)], -1)
            cuts = np.flatnonzero(here[1:] != here[:-1]) + 1
            depth += not len(cuts)
        parts: list[tuple[int, int]] = []
        for a, b in zip(np.append(0, cuts) + lo, np.append(cuts, hi - lo) + lo, strict=True):
            if parts and b - parts[-1][0] <= leaf:
                parts[-1] = (parts[-1][0], int(b))
            else:
                parts.append((int(a), int(b)))
        return parts, depth

    def _bounds(self) -> None:
        """Of each node the largest tf of each term and the smallest m and id below it, children before parents."""
        held: list[tuple[np.ndarray, np.ndarray]] = [None] * len(self.range)
        self.low = np.array([self.m[lo:hi].min() for lo, hi in self.range])
        self.first = np.array([self.ids[lo:hi].min() for lo, hi in self.range])
        for k in range(len(self.range) - 1, -1, -1):  # children have larger numbers than their parent
            (a, b), (lo, hi) = self.kids[k], self.range[k]
            if b > a:
                t, f = (np.concatenate(x) for x in zip(*held[a:b], strict=True))
            else:
                t, f = self.term[self.at[lo] : self.at[hi]], self.tf[self.at[lo] : self.at[hi]]
            order = np.argsort(t, kind="stable")
            t, f = t[order], f[order]
            begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            held[k] = t[begin], np.maximum.reduceat(f, begin)
        self.node_at = np.append(0, np.cumsum([len(t) for t, _ in held]))
        self.node_term = np.concatenate([t for t, _ in held])
        self.node_gain = weight(np.concatenate([f for _, f in held]), np.repeat(self.low, np.diff(self.node_at)))

    def search(self, wanted: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``top`` documents of ``best`` and the tree, by the weight of each term (0 for those not asked for)."""
        score, ids = best
        stack = [(_LAST, 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or len(score) == top and (bound < score[-1] or bound == score[-1] and self.first[node] > ids[-1]):
                continue
            a, b = self.kids[node]
            if b > a:
                s, e = self.node_at[a], self.node_at[b]
                bounds = np.add.reduceat(wanted[self.node_term[s:e]] * self.node_gain[s:e], self.node_at[a:b] - s)
                stack += [(int(bounds[k]), a + int(k)) for k in np.argsort(bounds, kind="stable")]
                continue
            lo, hi = self.range[node]
            s, e = self.at[lo], self.at[hi]
            got = np.add.reduceat(wanted[self.term[s:e]] * self.gain[s:e], self.at[lo:hi] - s)
            fit = np.flatnonzero(got >= (max(1, score[-1]) if len(score) == top else 1))
            if len(fit):
                score, ids = np.append(score, got[fit]), np.append(ids, self.ids[lo:hi][fit])
                first = np.lexsort((ids, -score))[:top]
                score, ids = score[first], ids[first]
        return score, ids


def _searched(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, count: int, total: int, top: int, block: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for each of ``items`` (terms by frequency, their weights)."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast((items, rank))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        parts: list[tuple] = []

        def tree() -> Tree:
            ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            term, doc = held.value[1][term], np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((term, doc))
            return Tree(ids, lengths(n, count, total), sizes, term[order], tf[order])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = np.array([_LAST if x is None else x for x in part.column("doc_id").to_pylist()], dtype=np.int64)
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf")]
                parts.append((ids, part.column("n").to_numpy(), part.column("term").value_lengths().to_numpy().astype(np.int64), *flat))
                if sum(len(p[0]) for p in parts) >= block:
                    yield tree()
        if parts:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ranks = held.value
        best = [(np.zeros(0, dtype=np.int64),) * 2] * len(asked)
        wanted = np.zeros(len(ranks), dtype=np.int64)
        for tree in trees(batches):
            for k, (terms, weights) in enumerate(asked):
                wanted[terms] = weights
                best[k] = tree.search(wanted, best[k], top)
                wanted[terms] = 0
        item = np.repeat(np.arange(len(asked)), [len(s) for s, _ in best])
        score, ids = (np.concatenate([b[k] for b in best]) if best else np.zeros(0, dtype=np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(ids, mask=ids == _LAST), pa.array(score)], ["item", "doc_id", "score"])

    return vectors.where("size(term) > 0").select("doc_id", "n", "term", "tf").mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, max_terms: int = MAX_TERMS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of ``docs`` (doc_id, text) for each item of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    terms = stored(_item_terms(benchmark), "item-terms")
    kind = terms.schema["item_id"].dataType.simpleString()
    groups = max(1, math.ceil(terms.count() / max_terms))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for g in range(groups):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        words = sorted({bytes(r["term"]) for r in rows})
        if not words:
            continue
        ids = {w: k for k, w in enumerate(words)}
        vectors = stored(_vectors(docs, ids), "vectors")
        count, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), dtype=np.int64)
        for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        order = np.lexsort((np.arange(len(words)), -df))
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words))
        w = [math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df]
        of: dict = defaultdict(list)
        for r in rows:
            k = ids[bytes(r["term"])]
            of[r["item_id"]].append((rank[k], w[k] * r["q"]))
        names = list(of)
        items = [tuple(np.array(x, dtype=np.int64) for x in zip(*of[name], strict=True)) for name in names]
        best = _searched(vectors, items, rank, count, total, top, block)
        order_by = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))  # an item's candidates grow with the number of tasks: first the best of parts of them
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", salt).orderBy(*order_by))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order_by))).where(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return out


# DuckDB: every document's score for every item by joins.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), b AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) WHERE item_id IS NOT NULL GROUP BY ALL
), s AS (
  SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0
), m AS (
  SELECT rid, doc_id, 25 + (75 * len(t) * docs) // total AS m FROM d, s WHERE len(t) > 0
), tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 10
"""
