"""Removal of repeated byte strings by suffix arrays of shards.

Each byte that lies in a string of ``length`` bytes that also starts anywhere else, in any text, is removed. A window is the string of ``length`` bytes at one place.

1. Windows are dealt to shards by content: a window's key is the smallest hash of the strings of ``gram`` bytes within it, so equal windows have equal keys. Windows
   side by side mostly share their key; such a run is a segment, some 170 windows long, known by its key, its place and a digest of its bytes.
2. Keys are counted with the smallest and largest digest. A key of one segment repeats nothing, unless its string of ``gram`` bytes occurs twice in it; where
   all segments of a key are equal, each repeats whole. Of the others each different segment is taken once, and those that occur several times repeat whole too.
3. The different segments of a key come together, many keys a shard, and the shard's suffix array is induced (``suffix_array``). Suffixes that share
   ``length`` bytes are neighbours in it, and the common prefixes in text order say which windows those are.
4. A key of more than ``MAX_GROUP`` different segments, as of a line that very many texts hold, is no single task's: its windows are counted one by one by
   digests of their own.
5. The ranges found are gathered by document and cut out.

Each row is a text of its own, whatever its id, so rows of the same text remove each other where they have ``length`` bytes; they are told by id and a hash of the text, and rows
alike in both are treated alike. Null text is empty. A text of fewer bytes than ``length`` keeps all. The ids of documents that segments or ranges belong to are broadcast while
there are at most ``MAX_BROADCAST_IDS``, so that other texts are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.llm import textcore
from soilspark.llm.storage import stored
from soilspark.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
MAX_GROUP = 4096
MAX_BROADCAST_IDS = 1_000_000  # some 40 bytes each
SHARD = 1 << 20  # bytes of segments from which a suffix array is made
SLICE = 1 << 20  # windows of a text looked at together
MOST_WINDOWS = 512  # of a segment
_OWN = "text_hash"


def _gram(length: int) -> int:
    return max(1, length * 4 // 25)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = textcore.mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64),) * 2


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to below ``n``."""
    global _powers
    if n > len(_powers[0]):
        _powers = tuple(np.cumprod(np.append(np.uint64(1), np.full(2 * n, x, dtype=np.uint64))) for x in (_BASE, _BACK))
    return _powers


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place, from sums of powers (mod 2^64)."""
    up, down = _power(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(_VALUE[data] * up[: len(data)]))
    n = len(data) - gram + 1
    return textcore.mix64((sums[gram:] - sums[:n]) * down[:n])


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` neighbours."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    blocks = np.concatenate([x, np.full(rows * w - len(x), np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(rows, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows, whether the key's string occurs twice) of each segment of ``data``."""
    gram = _gram(length)
    each, w = _gram_hashes(data, gram), length - gram + 1
    smallest = _smallest(each, w)
    begin = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1]))
    count, key = np.diff(np.append(begin, len(smallest))), smallest[begin]
    at = np.flatnonzero(each <= key.max())  # of the few that can be a key, the segments that hold them
    run, last = (np.searchsorted(begin, np.clip(x, 0, len(smallest) - 1), side="right") - 1 for x in (at - w + 1, at))
    times, value = np.zeros(len(key), dtype=np.int64), each[at]
    while len(run):
        times += np.bincount(run[key[run] == value], minlength=len(key))
        more = run < last
        run, last, value = run[more] + 1, last[more], value[more]
    again = times > 1
    parts = -(-count // MOST_WINDOWS)
    if (parts > 1).any():  # where a text repeats itself
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
        begin, key, again = np.repeat(begin, parts) + nth * MOST_WINDOWS, np.repeat(key, parts), np.repeat(again, parts)
    return key, begin, count, again


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of whole texts, or of parts of a long one that share ``length`` - 1 bytes, with (row, place in the text, place here, size here) of each."""
    for a, b in textcore.chunks(texts, SLICE):
        data, at = textcore.raw(texts.slice(a, b - a))
        if b - a > 1 or len(data) <= 2 * SLICE:
            yield data, [(a + k, 0, int(s), int(e - s)) for k, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e - s >= length]
            continue
        for s in range(0, len(data) - length + 1, SLICE):
            part = data[s : s + SLICE + length - 1]
            yield part, [(a, s, 0, len(part))]


def _found(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in _pieces(batch.column("text"), length):
                rows, keys, at, windows, digests, twice = [], [], [], [], [], []
                for row, shift, s, size in places:
                    part = data[s : s + size]
                    key, begin, count, again = _segments(part, length)
                    view = part.tobytes()
                    digests += [hashlib.blake2b(view[x : x + n + length - 1], digest_size=8).digest() for x, n in zip(begin.tolist(), count.tolist(), strict=True)]
                    rows.append(np.full(len(key), row))
                    keys.append(key)
                    at.append(begin + shift)
                    windows.append(count)
                    twice.append(again)
                if not rows:
                    continue
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column(_OWN).take(own), pa.array(np.concatenate(at).astype(np.int64)), pa.array(np.concatenate(windows).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.frombuffer(b"".join(digests), dtype=np.int64)), pa.array(np.concatenate(twice))],
                    ["doc_id", _OWN, "at", "windows", "key", "digest", "again"],
                )

    return run


def _cut_out(kind: str, length: int, texts: DataFrame) -> DataFrame:
    """The bytes of the segments listed in ``parts`` beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, raw = batch.column("parts"), batch.column("text")
            own = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
            flat = parts.flatten()
            cols = {c: flat.field(c) for c in ("key", "at", "windows", "once", "hot")}
            texts = [t.as_buffer() for t in raw]
            cut = [bytes(memoryview(texts[k])[a : a + n + length - 1]) for k, a, n in zip(own, cols["at"].to_pylist(), cols["windows"].to_pylist(), strict=True)]
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column(_OWN).take(rows), cols["key"], cols["at"], cols["once"], cols["hot"], pa.array(cut, pa.binary())], ["doc_id", _OWN, "key", "at", "once", "hot", "bytes"])

    return texts.mapInArrow(run, f"doc_id {kind}, {_OWN} long, key long, at long, once boolean, hot boolean, bytes binary")


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each of the byte strings the windows that start anywhere else in them, told from the suffix array of all."""
    sizes = np.array([len(p) for p in parts])
    end = np.cumsum(sizes + 1) - 1  # of each part, where a symbol below all bytes stands
    text = np.zeros(int(end[-1]) + 1, dtype=np.int16)
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int16) + 1
    inside = np.ones(len(text), dtype=bool)
    inside[end] = False
    text[inside] = raw
    begin = end - sizes
    common, before = common_prefixes(text, suffix_array(text), begin, int(sizes.max()) + 1)
    left = np.repeat(end, sizes + 1) - np.arange(len(text))
    hit = np.flatnonzero((common >= length) & (left >= length))
    marked = np.zeros(len(text), dtype=bool)
    marked[hit] = True
    marked[before[hit]] = True
    return [np.flatnonzero(marked[b:e]) for b, e in zip(begin, end, strict=True)]


def _ranges(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of neighbouring windows as ranges of bytes."""
    new = np.append(True, np.diff(windows) > 1)
    return windows[new], windows[np.append(new[1:], True)] + length


def _induced(length: int, shard: int):
    """Ranges of repeated bytes of segments that occur once, from rows sorted by key."""

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (doc, own, at, once, _), windows in zip(rows, repeats([r[4] for r in rows], length), strict=True):
            if once and len(windows):
                out += [(doc, own, at + int(s), at + int(e)) for s, e in zip(*_ranges(windows, length), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        kinds = None

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            out = marked(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", _OWN, "start", "end"])

        for batch in batches:
            kinds = kinds or (batch.column("doc_id").type, pa.int64(), pa.int64(), pa.int64())
            for doc, own, key, at, once, part in zip(*[batch.column(c).to_pylist() for c in ("doc_id", _OWN, "key", "at", "once", "bytes")], strict=True):
                if size >= shard and key != last:
                    yield emitted(held)
                    held, size = [], 0
                held.append((doc, own, at, once, part))
                size += len(part)
                last = key
        if held:
            yield emitted(held)

    return run


def _each_window(length: int):
    """A digest of each window of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (at, part) in enumerate(zip(batch.column("at").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
                n = len(part) - length + 1
                digests = np.frombuffer(b"".join(hashlib.blake2b(part[s : s + length], digest_size=16).digest() for s in range(n)), dtype=np.int64).reshape(n, 2)
                own = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in ("doc_id", _OWN, "once")], pa.array(np.arange(at, at + n)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], ["doc_id", _OWN, "once", "start", "w1", "w2"])

    return run


def _of(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on document and hash; rows without id meet."""
    r = right.withColumnsRenamed({"doc_id": "__doc", _OWN: "__own"})
    return left.join(r, left["doc_id"].eqNullSafe(r["__doc"]) & (left[_OWN] == r["__own"]), how).drop("__doc", "__own")


def _narrowed(texts: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """The texts of the documents that ``rows`` has, told without a shuffle if these are few enough."""
    ids = rows.select("doc_id", _OWN)
    return _of(texts, F.broadcast(ids), "left_semi") if ids.count() <= most else texts


def repeated(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP, shard: int = SHARD, max_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(doc_id, text_hash, spans): the ranges of bytes to be removed of each document that has any, unordered and overlapping."""
    spark = docs.sparkSession
    texts = _hashed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = stored(texts.where(F.octet_length("text") >= length).mapInArrow(_found(length), f"doc_id {kind}, {_OWN} long, at long, windows int, key long, digest long, again boolean"), "segments")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("again").alias("again"))
    keys = keys.where("n > 1 or again").select("key", ((F.col("lo") < F.col("hi")) | (F.col("n") == 1)).alias("mixed"))
    several = stored(found.drop("again").join(keys, "key"), "repeated-segments")
    one = [F.first(c).alias(c) for c in ("doc_id", _OWN, "at", "windows")]
    contents = stored(several.where("mixed").groupBy("key", "digest").agg(F.count("*").alias("n"), *one), "contents")
    groups = contents.groupBy("key").agg(F.count("*").alias("size"))
    whole = lambda df: df.select("doc_id", _OWN, F.col("at").alias("start"), (F.col("at") + F.col("windows") + (length - 1)).alias("end"))
    marks = whole(several.where("not mixed")).unionByName(whole(several.where("mixed").join(contents.where("n > 1").select("key", "digest"), ["key", "digest"], "left_semi")))

    parts = contents.join(groups, "key").select("doc_id", _OWN, F.struct("key", "at", "windows", (F.col("n") == 1).alias("once"), (F.col("size") > max_group).alias("hot")).alias("part"))
    by_doc = stored(parts.groupBy("doc_id", _OWN).agg(F.collect_list("part").alias("parts")), "segments-by-document")
    cut = stored(_cut_out(kind, length, _of(_narrowed(texts, by_doc, max_ids), by_doc, "inner")), "segment-bytes")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // (8 * shard)))
    tail = f"doc_id {kind}, {_OWN} long, start long, end long"
    induced = cut.where("not hot").repartition(shards, "key").sortWithinPartitions("key").drop("hot").mapInArrow(_induced(length, shard), tail)
    windows = stored(cut.where("hot").select("doc_id", _OWN, "at", "once", "bytes").mapInArrow(_each_window(length), f"doc_id {kind}, {_OWN} long, once boolean, start long, w1 long, w2 long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    by_window = windows.where("once").join(twice, ["w1", "w2"], "left_semi").select("doc_id", _OWN, "start", (F.col("start") + length).alias("end"))
    every = marks.unionByName(induced).unionByName(by_window).distinct()
    return every.groupBy("doc_id", _OWN).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(text).alias(_OWN), text.alias("text"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw, kept, at, gone, runs = text.as_py(), hashlib.sha256(), 0, 0, 0
            flat = spans.values
            starts, ends = (flat.field(c).to_numpy() for c in ("start", "end"))
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order])
            new = np.append(True, starts[1:] > ends[:-1])[: len(starts)]  # ranges that touch are one run
            for s, e in zip(starts[new].tolist(), ends[np.append(new[1:], True)[: len(ends)]].tolist(), strict=True):
                kept.update(raw[at:s])
                at, gone, runs = e, gone + e - s, runs + 1
            kept.update(raw[at:])
            rows.append((len(raw), gone, runs, kept.hexdigest()))
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP, shard: int = SHARD, max_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = stored(repeated(docs, length, max_group, shard, max_ids), "spans")
    texts = _hashed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    cut = lambda df: df.select("doc_id", "text", "spans").mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kept = lambda df: df.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    ids = spans.select("doc_id", _OWN)
    if ids.count() <= max_ids:
        return kept(_of(texts, F.broadcast(ids), "left_anti")).unionByName(cut(_of(_of(texts, F.broadcast(ids), "left_semi"), spans, "inner")))
    both = _of(texts, spans, "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    return cut(both)
