"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words, but not none, is one
window). A document word inside any occurrence of a window is hit. Each window is looked up by one
shingle only, the rarest of those it holds, counted over all documents: a text that contains the window
contains that shingle at a known offset (with containment 1 the necessary prefix is a single token). So
documents' shingles are joined with one token a window; the offset and both lengths bound the position,
and the words there are compared with the window's one by one. Shingles are of ``SHINGLE`` words, those of
shorter windows of as many as these have.

Documents are read in place, twice: to count shingles, and to find windows and count words at once; windows
are broadcast while there are at most ``MAX_BROADCAST_WINDOWS`` of them (some 300 bytes each), beyond that
the join shuffles shingles with the few words around them. What is found is grouped by document only as
counts and intervals.

Rows that share a doc_id count as one document's; null text has no words; a null doc_id is kept, without
hits. Benchmark rows without id mark hits but are not listed. Without benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilspark.llm.sqltext import words
from soilspark.llm.storage import stored

WINDOW = 10
SHINGLE = 3
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_IDS = 300_000  # some 100 bytes each with what is known of them


def _near(df: DataFrame, most: int) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), key, win (array of words): each window of each item."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    cut = split.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda s: F.slice("w", s, size))).alias("win"))
    return cut.select("item_id", F.md5(F.array_join("win", " ")).alias("key"), "win").distinct()


def _token(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _document_tokens(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, words, pos, kind, token of each position, for shingles of each of the ``lengths``. The tail's tokens cover fewer words; comparing the words sorts them
    out. A position more, behind the last word, stands for the document itself."""
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    n = F.size("words")
    shifted = [F.slice("words", j + 1, n).alias(f"s{j}") for j in range(max(lengths))]
    # outer: else the plan would split each text once more only to drop empty ones first
    turned = split.select("doc_id", "words", F.posexplode_outer(F.arrays_zip(*shifted, F.array_repeat(F.lit(0), n + 1).alias("end"))).alias("pos", "z"))
    tokens = [_token([F.col(f"z.s{j}") for j in range(k)]) for k in lengths]
    each = F.posexplode(F.array(*tokens)).alias("kind", "token")
    return turned.select("doc_id", "words", "pos", *([F.lit(0).alias("kind"), tokens[0].alias("token")] if len(tokens) == 1 else [each]))


def _found(docs: DataFrame, windows: DataFrame, window: int, max_broadcast: int) -> DataFrame:
    """doc_id, start, length, key: each occurrence of each of the ``windows`` (key, win; distinct, of at most ``window`` words), and n_words alone for each row of ``docs``."""
    n = windows.count()
    near = F.broadcast if n <= max_broadcast else lambda df: df
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("key"))
    if not n:
        return counted
    windows = windows.withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())
    parts = lambda o, k: _token([F.get("win", o + j) for j in range(k)])
    token = lambda o: F.coalesce(*[F.when(F.col("k") == k, parts(o, k)) for k in lengths])
    tokens = windows.select("key", "win", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("win") - F.col("k")), token)).alias("at", "token"))
    seen = _document_tokens(docs, lengths)
    counts = seen.select("token").join(near(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.struct("at", "token"), F.struct(F.coalesce("n", F.lit(0)), "token", "at"))
    prefix = stored(tokens.join(near(counts), "token", "left").groupBy("key", "win").agg(rarest.alias("r")).select("key", "win", "r.at", "r.token"), "prefix")
    start, length = F.col("pos") - F.col("at"), F.size("win")
    if n <= max_broadcast:
        held = F.slice("words", F.greatest(start, F.lit(0)) + 1, length)
        fits = (seen["token"] == prefix["token"]) & (start >= 0) & (start + length <= F.size("words")) & (held == F.col("win"))
        own = F.col("key").isNull() & (F.col("kind") == 0) & (F.col("pos") == F.size("words"))
        both = seen.join(F.broadcast(prefix), fits, "left").where(own | F.col("key").isNotNull())
        return both.select("doc_id", F.when(own, F.size("words")).cast("long").alias("n_words"), start.alias("start"), F.when(~own, length).alias("length"), "key")
    begin = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = seen.where("doc_id is not null").select("doc_id", "pos", "token", begin.alias("begin"), F.slice("words", begin + 1, 2 * window - 1).alias("around"))
    first = start - F.col("begin")
    held = F.slice("around", F.greatest(first, F.lit(0)) + 1, length)
    hits = around.join(prefix, (around["token"] == prefix["token"]) & (first >= 0) & (held == F.col("win")))
    return counted.unionByName(hits.select("doc_id", F.lit(None).cast("long").alias("n_words"), start.alias("start"), length.alias("length"), "key"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = stored(item_windows(benchmark, window), "windows")
    docs = docs.select("doc_id", "text")
    found = stored(_found(docs, windows.groupBy("key").agg(F.first("win").alias("win")), window, max_broadcast_windows), "found")
    hits = found.where("key is not null and doc_id is not null")
    before = Window.partitionBy("doc_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hits.select("doc_id", "start", "length").distinct().withColumn("past", F.max(end).over(before))
    covered = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce("past", F.lit(0))))
    words_hit = spans.groupBy("doc_id").agg(F.sum(covered).cast("long").alias("n_hit"))
    of = windows.select("key", "item_id").where("item_id is not null").distinct()
    pairs = hits.select("doc_id", "key").distinct().join(_near(of, max_broadcast_windows), "key").select("doc_id", "item_id").distinct()
    items = pairs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    marked = stored(words_hit.join(items, "doc_id", "left"), "marked")
    return found.where("key is null").select("doc_id", "n_words").join(_near(marked, MAX_BROADCAST_IDS), "doc_id", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are. Rows that share a doc_id go together; rows without id stay."""
    windows = stored(item_windows(benchmark, window), "windows")
    found = _found(docs.select("doc_id", "text"), windows.groupBy("key").agg(F.first("win").alias("win")), window, max_broadcast_windows)
    bad = stored(found.where("key is not null and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return docs.join(_near(bad, MAX_BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


# DuckDB: windows joined with every run of as many words of each document, by their text.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r.doc_id, r.s, r.n, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.t = win.t
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
