"""Document fingerprints by one-permutation MinHash.

Shingles of five words (a text of fewer words, but not none, is one shingle) are hashed once. The top
bits of a hash name one of ``BINS`` bins; each bin keeps its smallest hash. An empty bin borrows from the
first bin that holds something in an order of its own, hashed from the bin and the attempt (optimal
densification); should all attempts miss, it goes on through a permutation of all bins, so every empty
bin is filled. Of each bin the ``BITS`` low-order bits are packed. Two unequal values agree by chance in
one of 2**BITS cases, which the likeness corrects for.

Bins are found without a shuffle: a text's hashes are sorted together with a marker for the start of
each bin, and what follows a marker is the bin's minimum or the next marker. All of it are column
expressions; a text of any length is one array of hashes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from soilspark.llm.sqltext import words

SHINGLE = 5
BINS = 256
BITS = 8
ATTEMPTS = 64  # hashed attempts of an empty bin before the permutation
PER_LONG = 64 // BITS
ROWS_A_PIECE = 128  # documents of neighbouring ids that are handled together
MAX_PIECES = 32_768
SAMPLED = 8

_SHIFT = 63 - (BINS.bit_length() - 1)
_END = (1 << 63) - 2


def _filled(bins: Column, b: Column) -> Column:
    """What an empty bin ``b`` borrows."""
    hashed = [F.get(bins, F.xxhash64(b, F.lit(a)).bitwiseAND(BINS - 1).cast("int")) for a in range(ATTEMPTS)]
    step = F.xxhash64(b, F.lit(-1)).bitwiseAND(BINS - 2) + 1  # odd: all bins are passed
    rest = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda a: F.get(bins, (b + a * step).bitwiseAND(BINS - 1).cast("int"))), lambda v: v.isNotNull())
    return F.coalesce(*hashed, F.get(rest, F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as array<bigint> in ``out``: ``BINS * BITS / 64`` numbers; null if the text has no words."""
    w, v, h, s, m, d = (f"__{out}_{x}" for x in "wvhsmd")
    every = df.select("*", words(F.col(text)).alias(w))
    # each array is named at least twice in what reads it: named once, its computation would be moved into the lambda
    every = every.select(*[c for c in every.columns if c != w], F.when(F.size(w) > 0, F.transform(w, lambda x: F.xxhash64(x))).alias(v))
    last = F.greatest(F.size(v) - (SHINGLE - 1), F.lit(0))
    runs = F.transform(F.slice(v, 1, last), lambda x, i: F.xxhash64(x, *[F.get(v, i + j) for j in range(1, SHINGLE)]))
    every = every.select(*[c for c in every.columns if c != v], F.when(F.size(v) >= SHINGLE, runs).when(F.size(v) > 0, F.array(F.xxhash64(v))).alias(h))
    marked = F.concat(F.transform(F.col(h), lambda x: F.shiftrightunsigned(x, 1).bitwiseOR(F.lit(1).cast("long"))), F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _SHIFT)), F.array(F.lit(_END)))
    every = every.select(*[c for c in every.columns if c != h], F.when(F.size(h) > 0, F.sort_array(marked)).alias(s))
    even = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 0
    least = F.filter(F.col(s), lambda x, i: even(F.get(s, i - 1)) & F.col(s).isNotNull())
    held = F.transform(least, lambda v: F.when(~even(v), v))
    every = every.select(*[c for c in every.columns if c != s], held.alias(m))
    dense = F.transform(F.col(m), lambda v, b: F.shiftright(F.coalesce(v, _filled(F.col(m), b)), 1).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))
    every = every.select(*[c for c in every.columns if c != m], dense.alias(d))

    def packed(k: Column) -> Column:
        parts = [F.shiftleft(F.get(d, k * PER_LONG + j), BITS * j) for j in range(PER_LONG)]
        for p in parts[1:]:
            parts[0] = parts[0].bitwiseOR(p)
        return parts[0]

    return every.select(*[c for c in every.columns if c != d], F.when(F.col(d).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), packed)).alias(out))


def as_text(fingerprint: Column) -> Column:
    """Hexadecimal digits; those of a text without words are all 0."""
    shown = F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.coalesce(shown, F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, 0 to 1. Two texts without words are alike, one with and one without are not."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # the lowest bit of each byte becomes 1 if any of the byte is
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    agree = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x) / BINS
    chance = 0.5**BITS
    both = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


KEY = "struct<id:bigint,h:bigint,t:bigint>"


def _piece(key: Column, bounds: list[Row]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda some: F.from_json(F.lit(json.dumps([b.asDict() for b in some])), f"array<{KEY}>")  # noqa: E731  one constant, whatever its length
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    skip = below(literal(bounds[step - 1 :: step])) * step
    return skip + below(F.slice(literal(bounds), skip + 1, step))


def in_pieces(docs: DataFrame, rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``__key``, by which rows are ordered, and ``__piece``, ascending numbers of ranges of about ``rows_a_piece`` rows each.

    The key is doc_id (null first), then a hash of the text, then the place where a row was read, so that equal ids, and equal rows, are cut into pieces like others.
    The ends of pieces come from a sample by hash of ``SAMPLED`` keys a piece; there are at most ``MAX_PIECES``, beyond which pieces get longer (a window spills
    what it can't hold).
    """
    own = docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("t")))
    n = docs.count()
    pieces = min(MAX_PIECES, -(-n // rows_a_piece))
    bounds: list[Row] = []
    if pieces > 1:
        some = own.select("__key").where(F.pmod(F.xxhash64("__key"), F.lit(1 << 32)) < min(1 << 32, int(SAMPLED * pieces / n * (1 << 32)) + 1))
        ranked = some.withColumn("r", F.row_number().over(Window.orderBy("__key")))  # of the sample
        bounds = sorted((r["__key"] for r in ranked.where(F.pmod("r", F.lit(SAMPLED)) == 0).select("__key").collect()), key=lambda k: (k["id"] is not None, k))
    return own.withColumn("__piece", _piece(F.col("__key"), bounds))


def with_next(docs: DataFrame, carried: list[str], made: Callable[[DataFrame], DataFrame] = lambda df: df, rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """``made(docs)`` with ``next_<c>`` of each carried column: its value in the row of the next doc_id (null ids first, equal ids by a hash of their text; after the last the first).

    Rows are dealt by ranges of keys, each range is ordered by itself, and the first row of each range is added to the one before as its end.
    ``made`` adds columns, to the rows of ``docs`` and to those few once more.
    """
    own = in_pieces(docs, rows_a_piece)
    in_order = Window.orderBy("__piece")  # one row a piece, MAX_PIECES at most
    first = own.groupBy("__piece").agg(F.min("__key").alias("__first"))
    ends = first.select(F.lag("__piece").over(in_order).alias("__of"), "__first", F.max("__piece").over(Window.partitionBy(F.lit(0))).alias("__last"))
    ends = ends.select(F.coalesce("__of", "__last").alias("__of"), "__first")
    added = own.join(F.broadcast(ends), F.col("__key") == F.col("__first")).select(*docs.columns, "__key", F.col("__of").alias("__piece"), F.lit(True).alias("__end"))
    own, added = made(own.withColumn("__end", F.lit(False))), made(added)
    names = [c for c in own.columns if c not in ("__key", "__piece", "__end")]
    ordered = Window.partitionBy("__piece").orderBy("__end", "__key")
    both = own.unionByName(added)
    return both.select(*names, "__end", *[F.lead(c).over(ordered).alias(f"next_{c}") for c in carried]).where(~F.col("__end")).drop("__end")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: the fingerprint of its text and of its edited text, and how like its own are the edited text's and the next document's.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next document's. Null texts are
    empty; a null doc_id comes first in the order; rows of equal id are ordered by a hash of their text; one document alone is its own next; an empty table
    gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    joined = with_next(docs, ["text", "fp"], lambda df: with_fingerprint(df, "text", "fp"))
    edited = joined.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"))
    done = with_fingerprint(edited, "edited", "edited_fp")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
