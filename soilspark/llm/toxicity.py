"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and the beginnings of its words, hashed to ``BUCKETS`` numbers and counted. One weight a feature is
shared by all thresholds: P(grade > k) = logistic(w.x - t_k). The severity of a text is its expected grade, the sum of these
probabilities; it is rejected if a grade above 0 has at least the model's probability ``reject``.

Training. Labels say toxic or not. A sample of at most ``SAMPLE`` labelled documents of either kind is taken, the smallest by a hash
of their id, so the bound holds however many labels there are. Grades are 0 (not toxic), and for toxic documents 1 or 2: a word that
occurs in at least ``SEEN`` and a share ``SHARE`` of toxic sample documents and ``RATIO`` times as often as in others is telling, and a toxic document whose number of
telling words is above the median of toxic documents gets 2. Only features that are telling in this sense keep weights, which are
fitted by projected gradient descent and not negative: a long text never outweighs what is toxic in it.

``reject`` is chosen on one document in ``PARTS`` of the sample (by a hash of its id) for a model of the others: of the probabilities
that ``REJECTS`` lists the one that judges fewest wrongly. The model itself is then fitted to all of the sample. What is telling is counted on
the executors; the driver gets only the telling features of each sampled document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soilspark.llm.sampling import sampled
from soilspark.llm.storage import stored
from soilspark.llm.textcore import _VALUE, Words, _powers_to, chunks, mix64

BUCKETS = 1 << 22
BEGINNINGS = (3, 4, 5)  # bytes of a word's beginnings
SAMPLE = 3_000
SEEN = 2
SHARE = 0.005
RATIO = 25
GRADES = 3
REJECT = 0.5  # least probability of a grade above 0, where the sample is too small to choose it
REJECTS = tuple(k / 20 for k in range(2, 17))
PARTS = 4
LEAST = 30  # documents to choose it on
PENALTY = 2e-4
ROUNDS = 2000


@dataclass(frozen=True)
class Model:
    feature: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray
    reject: float = REJECT


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and of the beginnings of every longer word."""
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    found = [(doc, (words.hash % np.uint64(BUCKETS)).astype(np.int32))]
    powers = _powers_to(max(BEGINNINGS))
    head, done = np.zeros(len(doc), dtype=np.uint64), 0
    at, size = words.start_byte, words.size
    for n in BEGINNINGS:
        longer = size > n
        doc, at, size, head = doc[longer], at[longer], size[longer], head[longer]
        for j in range(done, n):
            head = head + _VALUE[words.data[at + j]] * powers[j]
        done = n
        found.append((doc, (mix64(head ^ np.uint64(0xABCD + n)) % np.uint64(BUCKETS)).astype(np.int32)))
    return np.concatenate([d for d, _ in found]), np.concatenate([f for _, f in found])


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count), ordered by text and feature."""
    doc, feature = features(Words(texts))
    key, count = np.unique(doc.astype(np.int64) * BUCKETS + feature, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature and the numbers of documents that hold it: toxic and other ones, of all parts and without the part that ``reject`` is chosen on."""
    for batch in batches:
        toxic, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for a, z in chunks(batch.column(2)):
            doc, feature, _ = _counts(batch.column(2).slice(a, z - a))
            name, place = np.unique(feature, return_inverse=True)
            bad, rest = toxic[a:z][doc] == 1, part[a:z][doc] != 0
            cols = [pa.array(np.bincount(place[m], minlength=len(name))) for m in (bad, ~bad, bad & rest, ~bad & rest)]
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), *cols], ["feature", "bad", "good", "bad_rest", "good_rest"])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_columns: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative weights and ascending thresholds of most likelihood, with a penalty on weights. Rows are (row, column, value) triples."""
    n = len(grade)
    w = np.zeros(n_columns)
    t = np.arange(grades - 1, dtype=float)
    seen_w, seen_t = np.zeros(n_columns), np.zeros(grades - 1)
    for _ in range(ROUNDS):
        score = np.bincount(row, weights=w[column] * value, minlength=n)
        at_most = np.column_stack([np.zeros(n), *(_logistic(b - score) for b in t), np.ones(n)])  # P(grade < k)
        upper, lower = at_most[np.arange(n), grade + 1], at_most[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = (du - dl) / n  # of the loss
        g_w = np.bincount(column, weights=g_score[row] * value, minlength=n_columns) + PENALTY * w
        g_t = np.array([(-du[grade == k].sum() + dl[grade == k + 1].sum()) / n for k in range(grades - 1)])
        seen_w += g_w**2
        seen_t += g_t**2
        w = np.maximum(0, w - 0.3 * g_w / np.sqrt(seen_w + 1e-12))
        t = np.maximum.accumulate(t - 0.3 * g_t / np.sqrt(seen_t + 1e-12) + np.arange(grades - 1) * 1e-6)
    return w, t


def _fitted(toxic: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, names: np.ndarray) -> Model:
    """The model of documents whose features ``names[column]`` are all telling."""
    number = np.bincount(row, weights=value, minlength=len(toxic))
    grade = np.where(toxic == 1, 1 + (number > np.median(number[toxic == 1])), 0)
    w, t = fit_ordinal(row, column, value, grade, len(names))
    return Model(names[w > 0].astype(np.int32), w[w > 0], t)


def _p_toxic(model: Model, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(model.feature, feature), max(0, len(model.feature) - 1))
    known = model.feature[at] == feature if len(model.feature) else np.zeros(len(feature), dtype=bool)
    return _logistic(np.bincount(row[known], weights=model.weight[at[known]] * value[known], minlength=n) - model.thresholds[0])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """toxic, part, text of at most ``sample`` labelled documents of either kind. An id has one text, the smallest if rows that share it differ."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = [sampled(known.where(F.col("toxic") == k), ["doc_id"], sample) for k in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int").alias("part")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(F.col("toxic").cast("int"), part, "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; the larger if there are several; null: no label).

    Without any toxic document in the sample every text is of grade 0.
    """
    none = Model(np.zeros(0, dtype=np.int32), np.zeros(0), np.full(GRADES - 1, 40.0))
    rows = stored(labelled(docs, labels, sample), "labelled")
    size = {(r["toxic"], r["rest"]): r["n"] for r in rows.groupBy("toxic", (F.col("part") != 0).alias("rest")).agg(F.count("*").alias("n")).collect()}
    bad_rest, good_rest = size.get((1, True), 0), size.get((0, True), 0)
    bad, good = bad_rest + size.get((1, False), 0), good_rest + size.get((0, False), 0)
    if not bad:
        return none

    def telling(a: str, b: str, n_a: int, n_b: int):
        share = (F.col(b) + 0.5) / max(1, n_b)
        return (F.col(a) >= max(SEEN, SHARE * n_a)) & (F.col(a) / max(1, n_a) >= RATIO * share)

    counts = rows.mapInArrow(_frequencies, "feature int, bad long, good long, bad_rest long, good_rest long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "bad_rest", "good_rest")])
    flags = counts.select("feature", telling("bad", "good", bad, good).alias("all"), telling("bad_rest", "good_rest", bad_rest, good_rest).alias("rest"))
    found = flags.where("all or rest").orderBy("feature").toPandas()
    names, of_all, of_rest = found["feature"].to_numpy(np.int64), found["all"].to_numpy(bool), found["rest"].to_numpy(bool)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks(batch.column(2)):
                doc, feature, count = _counts(batch.column(2).slice(a, z - a))
                place = np.minimum(np.searchsorted(names, feature), max(0, len(names) - 1))
                hit = names[place] == feature if len(names) else np.zeros(len(feature), dtype=bool)
                doc, place, count = doc[hit], place[hit], count[hit]
                begin = np.searchsorted(doc, np.arange(z - a + 1))
                cut = lambda x: pa.array([x[begin[i] : begin[i + 1]].tobytes() for i in range(z - a)], type=pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), cut(place.astype("<i4")), cut(count.astype("<i4"))], ["toxic", "part", "f", "c"])

    got = rows.mapInArrow(kept, "toxic int, part int, f binary, c binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["toxic"], r["part"], r["f"], r["c"]))
    toxic, part = np.array([r["toxic"] for r in got]), np.array([r["part"] for r in got])
    parts = [np.frombuffer(r["f"], dtype="<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(f) for f in parts])
    column = np.concatenate(parts)
    value = np.concatenate([np.frombuffer(r["c"], dtype="<i4") for r in got]).astype(float)

    def model(docs_: np.ndarray, features_: np.ndarray) -> Model:
        if not features_.any():
            return none
        use = docs_[row] & features_[column]
        return _fitted(toxic[docs_], (np.cumsum(docs_) - 1)[row[use]], (np.cumsum(features_) - 1)[column[use]], value[use], names[features_])

    reject = REJECT
    if min(bad_rest, good_rest, bad - bad_rest, good - good_rest) >= LEAST:
        p = _p_toxic(model(part != 0, of_rest), len(got), row, names[column], value)[part == 0]
        y = toxic[part == 0] == 1
        wrong = [int((y != (p >= r)).sum()) for r in REJECTS]
        best = [r for r, n in zip(REJECTS, wrong, strict=True) if n == min(wrong)]
        reject = best[len(best) // 2]
    return replace(model(np.ones(len(got), dtype=bool), of_all), reject=reject)


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic (of a grade above 0) and rejected.

    Null and empty texts have no features and severity near 0; all rows and columns stay, columns of these names are replaced; an empty
    table stays empty.
    """
    docs = docs.drop("severity", "p_toxic", "rejected")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, dtype=np.float32)
        table[model.feature] = model.weight
        for batch in batches:
            for a, z in chunks(batch.column(at)):
                part = batch.slice(a, z - a)
                doc, feature = features(Words(part.column(at)))
                weight = table[feature]
                hit = np.flatnonzero(weight)
                score = np.bincount(doc[hit], weights=weight[hit], minlength=z - a)
                above = _logistic(score[:, None] - model.thresholds[None, :])
                extra = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= model.reject)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=schema.names)

    return docs.mapInArrow(run, schema)
