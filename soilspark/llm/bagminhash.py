"""Near-duplicate classes of documents by BagMinHash signatures.

A document is the multiset of its shingles of five words (a text of fewer words, but not none, is one
shingle); similarity is the weighted Jaccard coefficient of two multisets, near means ``THRESHOLD`` or
more.

Signatures. Each shingle owns a Poisson process over (weight, time), weights discretised at the integers
and gathered in dyadic intervals [0,1), [1,2), [2,4), ... Each interval has a process of its own whose rate
is its width; a point carries a signature component and a position in the interval, and belongs to a
document if the position is below the shingle's count there. Each component keeps the document's
earliest point, so two documents agree in a component with the probability of their weighted Jaccard
similarity. Points are drawn interval by interval up to a time by which every component is likely to
have one, which is doubled for the documents where one has none: hierarchy and stop make it quick for
large counts and long texts alike.

Candidates. ``BANDS`` bands of ``ROWS`` components; documents that agree in a band share a bucket. Texts of
the same words in the same order are represented by their smallest id. Each document is compared with
one bucket's smallest id; classes are the connected components of the links that hold exactly. What
buckets of several classes hold is then compared across classes in blocks of bounded size: documents
whose length or signature (``SURE`` standard errors below the threshold) rule out all others go, the rest
is compared exactly, and each block returns the links that connect its classes. So no link is lost to
the choice of representatives, and a group of thousands of copies costs a few comparisons a document.

Hot buckets are aggregated, joined by ordinary joins, which Spark splits, or cut in blocks; no group is
collected anywhere and no pairs but links are emitted. Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.llm.storage import stored
from soilspark.llm.textcore import Words, chunks, mix64

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
COMPONENTS = BANDS * ROWS
SURE = 6.0
ELEMENT_BITS = 40  # of a shingle's hash; two texts of a thousand shingles share one by chance in a millionth of cases
MAX_BROADCAST_IDS = 1_000_000  # 8 MB
BLOCK = 384
WIDTH = 8192  # columns of the matrix that counts common shingles, at once

_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle of each text, ordered by text and hash."""
    hashes, doc = words.shingles(k)
    key = (doc.astype(np.uint64) << np.uint64(ELEMENT_BITS)) | (hashes >> np.uint64(64 - ELEMENT_BITS))
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(ELEMENT_BITS)).astype(np.int64), key & np.uint64((1 << ELEMENT_BITS) - 1), count


def multisets_of(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``multisets`` of any number of texts, a chunk's words at a time."""
    parts = []
    for a, z in chunks(texts):
        doc, element, count = multisets(Words(texts.slice(a, z - a)), k)
        parts.append(((doc + a).astype(np.int32), element, count.astype(np.int32)))
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, components: int = COMPONENTS) -> np.ndarray:
    """The earliest time of each component, ``n_docs`` x ``components``; infinite for a document without elements."""
    parts = [(doc, element, np.zeros(len(doc), dtype=np.uint64), np.ones(len(doc)), np.ones(len(doc)))]
    level, low = 1, 1
    while (more := count > low).any():
        d, e, c = doc[more], element[more], count[more]
        parts.append((d, e, np.full(len(d), level, dtype=np.uint64), np.full(len(d), float(low)), np.minimum(c - low, low).astype(float)))
        level, low = level + 1, low * 2
    doc, element, depth, width, below = (np.concatenate(p) for p in zip(*parts, strict=True))
    seed = mix64(element ^ mix64(depth + np.uint64(1)))
    total = np.bincount(doc, weights=below, minlength=n_docs)
    out = np.full(n_docs * components, np.inf)
    until = components * (np.log(components) + 4) / np.maximum(total, 1)
    open_docs = total > 0
    while open_docs.any():
        rows = np.flatnonzero(open_docs[doc])
        d, s, w, b = doc[rows], seed[rows], width[rows], below[rows]
        limit, t = until[d], np.zeros(len(rows))
        drawn = 0
        while len(d):
            x = mix64(s + np.uint64(drawn * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / w
            live = t < limit
            if not live.all():
                d, s, w, b, t, limit = d[live], s[live], w[live], b[live], t[live], limit[live]
                x = x[live]
            y = mix64(x ^ _STEP)
            held = (y >> np.uint64(32)).astype(float) * 2.0**-32 * w < b
            at = d * components + ((y & np.uint64(0xFFFFFFFF)) % np.uint64(components)).astype(np.int64)
            np.minimum.at(out, at[held], t[held])
            drawn += 1
        found = np.isfinite(out.reshape(n_docs, components)).all(axis=1)
        open_docs &= ~found
        until = until * 2
    return out.reshape(n_docs, components)


def _hashed(times: np.ndarray) -> np.ndarray:
    return mix64(times.view(np.uint64))


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = _hashed(sig).reshape(len(sig), n_bands, rows)
    out = np.arange(n_bands, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * _STEP + h[:, :, r])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, hash of the text, key (of the words in order), weight, band hashes, sixteen bits of each component."""
    for batch in batches:
        for a, z in chunks(batch.column(1)):
            words = Words(batch.column(1).slice(a, z - a))
            n = z - a
            doc, element, count = multisets(words)
            sig = signatures(doc, element, count, n)
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            order = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts()).astype(np.uint64)
            ends = np.zeros((2, n), dtype=np.uint64)
            for k in (0, 1):
                terms = np.append(mix64(words.hash + (order + np.uint64(k + 1)) * np.uint64(0xD1342543DE82EF95 + 2 * k)), np.uint64(0))
                sums = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
                ends[k] = mix64(sums[words.first[1:]] - sums[words.first[:-1]] + np.uint64(k))
            key = ends.T.astype(np.uint64).tobytes()
            low = (_hashed(sig) & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, n),
                    batch.column(2).slice(a, n),
                    pa.array([key[16 * i : 16 * i + 16] for i in range(n)], type=pa.binary()),
                    pa.array(weight),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands(sig).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(low.astype(np.int32).ravel()), COMPONENTS).cast(pa.list_(pa.int32())),
                ],
                ["id", "h", "key", "weight", "bands", "low"],
            )


def similarity(a: str, b: str, k: int = SHINGLE) -> float:
    """Exact weighted Jaccard similarity of two texts' shingles."""
    return float(_overlaps(pa.array([a, b]), np.array([0]), np.array([1]), k)[0])


def _overlaps(texts: pa.Array, left: np.ndarray, right: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    doc, element, count = multisets(Words(texts), k)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        p, q = slice(begin[x], begin[x + 1]), slice(begin[y], begin[y + 1])
        _, ip, iq = np.intersect1d(element[p], element[q], assume_unique=True, return_indices=True)
        both = int(np.minimum(count[p][ip], count[q][iq]).sum())
        either = int(count[p].sum() + count[q].sum()) - both
        out[i] = both / either if either else 1.0
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        for a, z in chunks(left, 700_000):
            n = z - a
            texts = pa.concat_arrays([left.slice(a, n).cast(pa.large_string()), right.slice(a, n).cast(pa.large_string())])
            sim = _overlaps(texts, np.arange(n), np.arange(n, 2 * n))
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).filter(keep), batch.column(1).slice(a, n).filter(keep)], ["a", "b"])


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST_IDS else df


def _texts(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the ``nodes`` (id), whose documents ``reps`` (id, doc, h) names and ``docs`` (id, h, text) holds, perhaps in several equal rows."""
    wanted = stored(nodes.join(reps.select("id", "doc", "h"), "id").withColumnsRenamed({"id": "node", "doc": "id"}), "wanted")
    found = docs.join(_near(wanted, wanted.count()), ["id", "h"]).groupBy("node").agg(F.min("text").alias("text"))
    return stored(found.withColumnRenamed("node", "id"), "texts")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = _texts(ids, reps, docs)
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(lambda batches: _verify(batches, threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): root is the smallest id that it is connected with.

    Alternates two contractions, of neighbours above and below each id, until every edge ends in a root; each round is written out, and so are the smallest neighbours, so
    that the join with the edges of an id of very many neighbours can be split.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = stored(small, "small")
        ends = small.select(F.col("b").alias("a")).distinct()
        if small.join(ends, "a", "left_semi").isEmpty() and small.groupBy("a").count().where("count > 1").isEmpty():
            return small.select(F.col("a").alias("id"), F.col("b").alias("root")).union(small.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        edges = small


def _dealt(labelled: DataFrame) -> DataFrame:
    """(id, root, bucket, i, j): the rows of ``labelled`` in buckets of several classes, in groups of at most two blocks of about ``BLOCK`` rows each.

    The rows outside a bucket's largest class meet in a group with every other row of the bucket; rows of the largest class don't meet one
    another, as they need no further link. So a bucket of one huge class and a few others costs in proportion to its rows.
    """
    sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    per = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = stored(per.select("bucket", "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("p"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int").alias("q")), "blocks")
    rows = labelled.join(blocks, "bucket")
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("p")).otherwise(F.col("q"))).cast("int")
    key = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    rows = rows.withColumn("own", own)
    with_main = F.transform(F.sequence(F.lit(1), F.col("q")), lambda k: key(k - 1, -1 - F.col("own")))
    among = F.transform(F.sequence(F.lit(1), F.col("q")), lambda k: key(F.least(k - 1, F.col("own")), F.greatest(k - 1, F.col("own"))))
    to_main = F.transform(F.sequence(F.lit(1), F.col("p")), lambda k: key(F.col("own"), -k))
    keyed = rows.select("id", "root", "bucket", F.explode(F.when(is_main, with_main).otherwise(F.concat(among, to_main))).alias("g"))
    return keyed.select("id", "root", "bucket", "g.i", "g.j")


def _grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over the rows of each (bucket, i, j). Groups are bounded, small and many, so they are cut out of sorted batches here."""
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            k = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), k.shape[1]]
            for a, z in zip(cuts, cuts[1:], strict=False):
                now = tuple(k[:, a])
                if held and now != last:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, z - a))
                last = now
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _alike(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The ids of the group that, by length and signature, may be near an id of another class."""
    ids, root, weight = (group.column(c).to_numpy() for c in ("id", "root", "weight"))
    if len(ids) < 2 or (root == root[0]).all():
        return
    low = group.column("low").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.int32)
    least = COMPONENTS * (threshold - SURE * (threshold * (1 - threshold) / COMPONENTS) ** 0.5)
    found = np.zeros(len(ids), dtype=bool)
    for i in range(len(ids)):
        other = (root != root[i]) & (np.minimum(weight, weight[i]) >= threshold * np.maximum(weight, weight[i]))
        if other.any():
            found[i] = ((low[other] == low[i]).sum(axis=1) >= least).any()
    if found.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids[found])], ["id"])


def overlaps(texts: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """The exact weighted Jaccard similarity of each two texts."""
    doc, element, count = multisets_of(texts, k)
    total = np.bincount(doc, weights=count, minlength=len(texts))
    copies = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # a shingle's second copy is an element of its own
    doc, element = np.repeat(doc, count), mix64(np.repeat(element, count) + mix64(copies.astype(np.uint64)))
    _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    doc, (_, column) = doc[shared], np.unique(column[shared], return_inverse=True)
    both = np.zeros((len(texts), len(texts)))
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, z = np.searchsorted(column, (at, at + WIDTH))
        part = np.zeros((len(texts), WIDTH), dtype=np.float32)
        part[doc[a:z], column[a:z] - at] = 1
        both += part @ part.T
    either = total[:, None] + total[None, :] - both
    out = np.divide(both, either, out=np.ones_like(both), where=either > 0)
    np.fill_diagonal(out, 1.0)  # what only one text has is not in the matrix
    return out


def _linked(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the group across classes, enough to connect what is connected here."""
    ids, root = group.column("id").to_numpy(), group.column("root").to_numpy()
    if len(ids) < 2 or (root == root[0]).all():
        return
    x, y = np.nonzero(np.triu(overlaps(group.column("text").combine_chunks()) >= threshold, 1))
    top = {int(r): int(r) for r in root}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    out = []
    for i, j in zip(x, y, strict=True):
        p, q = find(int(root[i])), find(int(root[j]))
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([int(p) for p, _ in out]), pa.array([int(q) for _, q in out])], ["a", "b"])


def _nodes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """(key, id, doc): the documents of the same words in the same order are one node; doc is the smallest of their ids, and id the node's own number, which is doc
    unless rows that share that id differ in their words; then it is a negative number of its own. And whether there are such."""
    first = stored(signed.groupBy("key").agg(F.min("id").alias("doc")), "first")  # else joins would inherit its dealing by key, which Spark can't split
    shared = stored(first.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("shared")), "shared")
    n = shared.count()
    if not n:
        return first.withColumn("id", F.col("doc")), False
    lowest = first.agg(F.min("doc")).first()[0]
    own = F.least(F.lit(lowest), F.lit(0)) - 1 - F.monotonically_increasing_id()
    numbered = first.join(_near(shared, n), "doc", "left").select("key", F.when(F.col("shared"), own).otherwise(F.col("doc")).alias("id"), "doc")
    return stored(numbered, "nodes"), True  # written, so that the numbers stay


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (id, h, text; no null id): (id, h, node, weight) of each row, and (node, doc, root) of each node; root is the same for the nodes of a class."""
    signed = stored(docs.select("id", "text", "h").mapInArrow(_sign, "id long, h long, key binary, weight long, bands array<long>, low array<int>"), "signed")
    nodes, several = _nodes(signed)
    member = stored(signed.join(nodes.select("key", F.col("id").alias("node")), "key").select("id", "h", "node", "weight"), "member")
    own = nodes.withColumnsRenamed({"id": "node", "doc": "id"})
    reps = signed.where("weight > 0").join(own, ["key", "id"]).select(F.col("node").alias("id"), F.col("id").alias("doc"), "h", "weight", "bands", "low")
    reps = stored(reps.groupBy("id").agg(F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("doc", "weight", "bands", "low")]), "reps")  # but for h alike in all rows of a node
    buckets = stored(reps.select("id", "weight", F.explode("bands").alias("bucket")), "buckets")
    near = lambda p, q: F.least(p, q) >= threshold * F.greatest(p, q)
    # first each node with the smallest id of a bucket, the one that it shares most buckets with
    leaders = stored(buckets.groupBy("bucket").agg(F.min_by(F.struct("id", "weight"), "id").alias("l"), F.count("*").alias("n")).where("n > 1"), "leaders")
    met = buckets.join(leaders, "bucket").where((F.col("id") != F.col("l.id")) & near(F.col("weight"), F.col("l.weight")))
    shared = met.groupBy(F.col("id").alias("a"), F.col("l.id").alias("b")).count()
    pairs = stored(shared.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b")), "pairs")
    links = stored(verified(pairs, reps, docs, threshold), "links")
    roots = stored(components(links), "roots")
    # then what buckets of several classes hold, across classes
    labelled = stored(buckets.select("id", "bucket").join(roots, "id", "left").select("id", "bucket", F.coalesce("root", "id").alias("root")), "labelled")
    dealt = stored(_dealt(labelled), "dealt")
    alive = _grouped(dealt.join(reps.select("id", "weight", "low"), "id"), lambda g: _alike(g, threshold), "id long").distinct()
    alive = stored(alive, "alive")
    if alive.count():
        more = _grouped(dealt.join(_texts(alive, reps, docs), "id"), lambda g: _linked(g, threshold), "a long, b long").distinct()
        roots = stored(components(links.union(more)), "roots")
    whole = nodes.select(F.col("id").alias("node"), "doc").join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    if several:  # the smallest number of a class need not be one of its documents
        whole = stored(whole, "whole")
        least = stored(whole.groupBy("root").agg(F.min("doc").alias("class_id")), "least")
        whole = whole.join(least, "root")
    else:
        whole = whole.withColumn("class_id", F.col("root"))
    return member, stored(whole, "classes")


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_shingles) for each row of ``docs`` (doc_id, text): class_id is the smallest id of its class, itself if alone.

    Null and empty texts (and texts without words) have no shingles and are copies of one another. Equal texts always share a class. Rows that share an id but differ
    in their words are documents of their own: each has the class of its text, wherever rows lie. A null id is a class of its own (null). An empty table gives no rows;
    other columns are ignored.
    """
    docs = _documents(docs)
    member, whole = _classified(docs.where("id is not null"), threshold)
    out = member.join(whole, "node").select(F.col("id").alias("doc_id"), "class_id", F.col("weight").alias("n_shingles"))
    lost = docs.where("id is null").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_shingles"))
    return out.unionByName(lost)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the row of the smallest id, all columns as they are. Rows without id stay.

    Of rows that share this id and the class the one whose text has the smallest hash stays, of rows that also share this text one; so no text goes without a copy or
    near copy that stays.
    """
    member, whole = _classified(_documents(docs).where("id is not null"), threshold)
    heads = whole.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("r")).select(F.col("r.doc").alias("id"), F.col("r.node").alias("node"))
    kept = stored(member.join(heads, ["id", "node"]).groupBy("node").agg(F.min("id").alias("__id"), F.min("h").alias("__h"), F.count("*").alias("n")), "kept")
    once, repeated = kept.where("n = 1").select("__id", "__h"), kept.where("n > 1").select("__id", "__h")
    n, m = once.count(), repeated.count()
    rows = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__t": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    own = lambda some: (F.col("__i") == some["__id"]) & (F.col("__t") == some["__h"])
    out = rows.join(_near(once, n), own(once), "left_semi").select(*docs.columns)
    if m:  # one row of those that share id and text, or one of the several texts of a node
        out = out.unionByName(rows.join(_near(repeated, m), own(repeated), "left_semi").dropDuplicates(["__i", "__t"]).select(*docs.columns))
    return out.unionByName(docs.where("doc_id is null"))
