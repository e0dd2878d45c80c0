"""Phrase collocations by set-oriented mining (SETM) of sorted occurrence relations.

A text, A-Z lower-cased, is split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and tabs. The relation of length k
holds (block, position, group) of every occurrence of a frequent phrase of k words; a block is a run of whole pieces, and a position is left
free between pieces. It is kept as Parquet, a row a block, sorted by position:

1. Words are counted over all texts, by language; the frequent ones are the groups of length 1.
2. A relation is merge-joined with itself on block and the next position: two groups side by side are a phrase of one word more. These are
   counted, and the frequent ones get numbers.
3. What the merge-join gives is semi-joined with them and written as the relation of the next length, which 2. extends.

A phrase is frequent only if both its ends are, so nothing is lost, and all counts are exact. Groups are looked up in the tasks while there are at
most ``MAX_BROADCAST`` of them (some 100 bytes each), beyond that occurrences are shuffled to them and back to their blocks.

Rows are taken one by one, whatever their id: repeated rows count as often as they occur. Null text is empty, null language is ``und``;
a language without candidates, as of an empty table, has no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilspark.llm.storage import stored

LEAST = 100
LONGEST = 5
TOP = 2000
SHARE = 100  # percent of a phrase's occurrences within a longer one from which it is dropped
MAX_BROADCAST = 1_000_000
BLOCK = 1 << 13  # positions from which a block ends at the next piece's end
SLICE = 1 << 20  # bytes of a text split at once
FLUSH = 60_000  # counts of words held by a task before they are sent on
PAIRS = 500_000  # occurrences of pairs held before they are counted
ROWS = 256  # blocks, or texts, that a task is handed at once
_SALTS = 64

# fixed values: what ends a piece (. , ; : ! ? and U+000A to U+000D), and the second of the two characters between words
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_EMPTY, _BREAK, _RARE = -2, -3, -1


def _slices(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a lower-cased text with all breaks as line feeds, cut between words, and whether a piece ends there."""
    text, at = text.lower().translate(_BREAKS), 0
    while len(text) - at > SLICE:
        to = text.rfind(b"\n", at, at + SLICE) + 1
        ends = to > at
        if not ends:
            to = text.rfind(b" ", at, at + SLICE) + 1
        if to <= at:  # a word longer than a slice
            near = [x for x in (text.find(b" ", at + SLICE), text.find(b"\n", at + SLICE)) if x >= 0]
            to = min(near) if near else len(text)
        yield text[at:to], ends
        at = to
    yield text[at:], True


def _split(part: bytes) -> list[bytes]:
    """Words, line feeds for breaks, and empty strings that mean nothing."""
    return part.replace(b"\n", b" \n ").split(b" ")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def flushed() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w not in (b"", b"\n")]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            for part, _ in _slices(text.as_py()):
                held -= len(counts[name])
                counts[name].update(_split(part))
                held += len(counts[name])
                if held > FLUSH:
                    yield flushed()
                    held = 0
    yield flushed()


def _block(pos: list[np.ndarray], value: list, kind: pa.DataType) -> pa.RecordBatch:
    """One row of the arrays joined."""
    p = pa.array(np.concatenate(pos) if pos else np.zeros(0, dtype=np.int32), pa.int32())
    v = pa.array(np.concatenate(value) if pos else [], kind)
    whole = pa.array([0, len(p)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, p), pa.ListArray.from_arrays(whole, v)], ["pos", "value"])


def _blocks(batches: Iterator[pa.RecordBatch], number) -> Iterator[tuple[list, list]]:
    """(positions, values) of each block, in parts; ``number(lang, words)`` gives the places among ``words`` that are kept, their values, and how many places there are."""
    pos, value, at = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for part, ends in _slices(text.as_py()):
                held, kept, n = number(lang.as_py(), _split(part))
                if len(held):
                    pos.append((held + at).astype(np.int32))
                    value.append(kept)
                at += n + ends
                if ends and at >= BLOCK:
                    yield pos, value
                    pos, value, at = [], [], 0
            at += 1
    yield pos, value


def _relation_near(ids: dict[str, dict[bytes, int]]):
    """The first relation, words looked up in the tasks."""

    def number(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        of = ids.get(lang, {b"": _EMPTY, b"\n": _BREAK})
        got = np.fromiter(map(of.get, words, repeat(_RARE)), dtype=np.int64, count=len(words))
        got = got[got != _EMPTY]
        held = np.flatnonzero(got >= 0)
        return held, got[held], len(got)

    return lambda batches: (_block(p, v, pa.int32()) for p, v in _blocks(batches, number))


def _relation_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of each block with their language, for a join; the value is ``lang`` + line feed + word."""

    def number(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        words = [w for w in words if w]
        held = [k for k, w in enumerate(words) if w != b"\n"]
        return np.array(held, dtype=np.int64), np.array([lang.encode() + b"\n" + words[k] for k in held], dtype=object), len(words)

    return (_block(p, v, pa.binary()) for p, v in _blocks(batches, number))


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of each block with itself on the next position: row, position and both groups, by row and position."""
    pos, gid = batch.column("pos"), batch.column("gid")
    p, g = pos.flatten().to_numpy(zero_copy_only=False), gid.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(pos)), pos.value_lengths().to_numpy(zero_copy_only=False))
    at = np.flatnonzero((p[1:] == p[:-1] + 1) & (row[1:] == row[:-1]))
    return row[at], p[at], g[at], g[at + 1]


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def _pairs_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.int64),) * 2
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    for batch in batches:
        _, _, a, b = _adjacent(batch)
        held.append(_packed(a, b))
        if sum(map(len, held)) > PAIRS:
            yield flushed()
    yield flushed()


def _extended(keys: np.ndarray, gids: np.ndarray):
    """The next relation: of what stands side by side the occurrences whose pair is among the sorted ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, p, a, b = _adjacent(batch)
            key = _packed(a, b)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[at] == key
            ends = pa.array(np.searchsorted(row[there], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(p[there])), pa.ListArray.from_arrays(ends, pa.array(gids[at[there]]))], ["pos", "gid"])

    return run


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` with gid: numbers from 0 without gaps, kept with the rows. Partitions are counted, their few sums are added up on the driver."""
    rows = stored(df.withColumn("__id", F.monotonically_increasing_id()), label, ROWS)
    part = F.shiftrightunsigned("__id", 33)
    sizes = sorted(rows.groupBy(part.alias("p")).count().collect())
    begin, total = {}, 0
    for r in sizes:
        begin[r["p"]], total = total, total + r["count"]
    if total >= 1 << 31:
        raise OverflowError("more frequent phrases than numbers of 31 bits")
    begins = df.sparkSession.createDataFrame(list(begin.items()), "__part long, __begin long")
    return rows.join(F.broadcast(begins), part == F.col("__part")).select(*df.columns, (F.col("__begin") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias("gid"))


def _regrouped(rows: DataFrame) -> DataFrame:
    """Occurrences (block, pos, gid) as rows of blocks again."""
    both = F.sort_array(F.collect_list(F.struct("pos", "gid")))
    return rows.groupBy("block").agg(both.alias("o")).select(F.col("o.pos").alias("pos"), F.col("o.gid").alias("gid"))


RELATION = "pos array<int>, gid array<int>"


def _first_relation(docs: DataFrame, words: DataFrame, n: int, near: bool) -> DataFrame:
    spark = docs.sparkSession
    if near:
        ids: dict[str, dict[bytes, int]] = defaultdict(lambda: {b"": _EMPTY, b"\n": _BREAK})
        for r in words.select("lang", "word", "gid").toLocalIterator():
            ids[r["lang"]][bytes(r["word"])] = r["gid"]
        held = spark.sparkContext.broadcast(dict(ids))
        return _texts(docs).mapInArrow(lambda batches: _relation_near(held.value)(batches), "pos array<int>, value array<int>").withColumnRenamed("value", "gid")
    each = _texts(docs).mapInArrow(_relation_far, "pos array<int>, value array<binary>").withColumn("block", F.monotonically_increasing_id())
    each = each.select("block", F.explode(F.arrays_zip("pos", "value")).alias("o")).select("block", "o.pos", F.col("o.value").alias("key"))
    keyed = words.select(F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), F.col("word")).alias("key"), "gid")
    return _regrouped(each.join(keyed, "key").select("block", "pos", F.col("gid").cast("int").alias("gid")))


def _next_relation(relation: DataFrame, groups: DataFrame, near: bool) -> DataFrame:
    spark = relation.sparkSession
    if near:
        table = groups.select("a", "b", "gid").toPandas()
        key = _packed(table["a"].to_numpy(np.int64), table["b"].to_numpy(np.int64))
        order = np.argsort(key)
        held = spark.sparkContext.broadcast((key[order], table["gid"].to_numpy(np.int32)[order]))
        return relation.mapInArrow(lambda batches: _extended(*held.value)(batches), RELATION).where("size(pos) > 0")
    each = relation.withColumn("block", F.monotonically_increasing_id())
    after = F.transform(F.sequence(F.lit(1), F.size("pos") - 1), lambda i: F.struct(F.get("pos", i - 1).alias("pos"), F.get("pos", i).alias("to"), F.get("gid", i - 1).cast("long").alias("a"), F.get("gid", i).cast("long").alias("b")))
    side = each.where("size(pos) > 1").select("block", F.explode(after).alias("o")).select("block", "o.*").where("to = pos + 1")
    return _regrouped(side.join(groups.select("a", "b", "gid"), ["a", "b"]).select("block", "pos", F.col("gid").cast("int").alias("gid")))


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the frequent phrases: gid, a, b (the groups of their first and their last words but one), lang, phrase, last, f,
    pre and suf (occurrences of their first and last 1, 2, ... words), fa and fb."""
    counts = stored(_texts(docs).mapInArrow(_words_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words", ROWS)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _numbered(counts.where(F.col("n") >= least), "groups")
    none = F.array().cast("array<long>")
    word = F.col("word").cast("string")
    found = [words.select("gid", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "lang", word.alias("phrase"), word.alias("last"), F.col("n").alias("f"), none.alias("pre"), none.alias("suf"), *[F.lit(None).cast("long").alias(c) for c in ("fa", "fb")])]
    n = words.count()
    relation = stored(_first_relation(docs, words, n, n <= max_broadcast), "occurrences", ROWS)
    for k in range(2, longest + 1):
        pairs = relation.mapInArrow(_pairs_counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        groups = _numbered(pairs, "groups")
        head = found[-1].select(F.col("gid").alias("a"), "lang", F.col("phrase").alias("head"), F.col("f").alias("fa"), "pre")
        tail = found[-1].select(F.col("gid").alias("b"), "last", F.col("f").alias("fb"), "suf")
        grown = groups.join(head, "a").join(tail, "b").select(
            "gid", "a", "b", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f",
            F.concat("pre", F.array("fa")).alias("pre"), F.concat("suf", F.array("fb")).alias("suf"), "fa", "fb",
        )
        found.append(stored(grown, "phrases"))
        n = groups.count()
        if not n:
            break
        if k < longest:
            relation = stored(_next_relation(relation, groups, n <= max_broadcast), "occurrences", ROWS)
    return totals, found


def _scored(k: int) -> Column:
    """The struct (score, k, l, r) of the lowest cut of a phrase of ``k`` words; ties go to the smallest first part."""
    exact = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for j in range(1, k):
        left, right = F.get("pre", F.lit(j - 1)), F.get("suf", F.lit(k - j - 1))
        score = F.call_function("div", exact(F.lit(1000) * F.col("f")) * exact(F.col("n")), exact(left) * exact(right))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the lowest-scoring cut, ``n`` all words of the language; the score is floor(1000 a n / (l r)), exact.
    A phrase that lies in a longer one of at least ``share`` percent of its occurrences is dropped; as counts never rise with a word more, one word more tells.
    """
    totals, found = levels(docs, least, longest, max_broadcast)
    out = None
    for k, level in enumerate(found[1:], 2):
        one = level.join(F.broadcast(totals), "lang").withColumn("s", _scored(k))
        if k < len(found):
            longer = found[k]
            within = [longer.where(F.col("f") * 100 >= share * F.col(whole)).select(F.col(part).alias("gid")) for part, whole in (("a", "fa"), ("b", "fb"))]
            one = one.join(within[0].unionByName(within[1]).distinct(), "gid", "left_anti")
        one = one.select("lang", "phrase", F.col("f").alias("a"), "s.l", "s.r", "n", "s.score")
        out = one if out is None else out.unionByName(one)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))  # the best of parts of a language first, so no task sorts all its phrases
    part = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# DuckDB: all runs of words counted by their text.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
  ) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100
), cut AS (
  SELECT lang, phrase, k, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, h.f AS l, t.f AS r, n, ((1000 * cut.a::HUGEINT * n) // (h.f::HUGEINT * t.f))::BIGINT AS score, j
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail JOIN total ON total.lang = cut.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND y.a >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000
"""
