"""Collocations, ranked search and repeated bytes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from soilspark.llm import collocations, lexical_search, suffix_array, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# phrases


def mined(rows, least, longest, top, share=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * n >= share * a and within(p, q) for q, n in able.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(2)
    vocabulary = ["la", "mer", "é", "été", "von", "new", "york", "x\x0bx".replace("\x0b", "-"), "Der", "…", "日本", "a b"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), some(rng.randint(0, 60)) + rng.choice([".", ";", "\t", "\r\n", " , ", "!?"]) + some(rng.randint(0, 30))) for _ in range(70)]
    rows += [("en", "new york city is far. new york city is near")] * 30 + [("en", None), ("de", ""), (None, " \t "), ("fr", "one"), ("en", "w" * 5000 + " new york " + "w" * 5000)]
    rows.append(("en", "la mer " * 4000))
    return rows


@pytest.mark.parametrize(("limit", "slice_"), [(collocations.MAX_BROADCAST, 1 << 20), (0, 1 << 20), (collocations.MAX_BROADCAST, 50)])
def test_collocations_equal_brute_force(spark, phrases, limit, slice_, monkeypatch):
    docs = spark.createDataFrame([(k, lang, text, 7) for k, (lang, text) in enumerate(phrases)], "doc_id long, lang string, text string, word int").repartition(3)
    if slice_ < 1000:  # in the driver, as tasks have modules of their own
        monkeypatch.setattr(collocations, "SLICE", slice_)
        for text in ("a b, c " * 40, "x" * 200, "y" * 60 + " z, " + "x" * 70 + ".q", ""):
            parts = [w for part, _ in collocations._slices(text.encode()) for w in collocations._split(part) if w]
            assert parts == [w for w in collocations._split(text.encode().translate(collocations._BREAKS)) if w]
        return
    got = collocations.collocations(docs, least=4, top=25, max_broadcast=limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(phrases, 4, 5, 25)
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == want


def test_collocations_that_are_nearly_within_longer_ones_and_empty_tables(spark, phrases):
    docs = spark.createDataFrame(phrases, "lang string, text string")
    for share in (60, 90):
        assert sorted(map(tuple, collocations.collocations(docs, least=15, longest=4, share=share).collect())) == mined(phrases, 15, 4, 2000, share)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    a, left, right, n = 3_000_000_019, 3_000_000_037, 5_000_000_029, 9_000_000_000_000_007
    row = spark.range(1).select(F.lit(a).alias("f"), F.array(F.lit(left)).alias("pre"), F.array(F.lit(right)).alias("suf"), F.lit(n).alias("n")).select(collocations._scored(2).alias("s")).first()
    assert row["s"]["score"] == 1000 * a * n // (left * right)


# search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def searched(docs, items, top=10):
    terms = [(i, [t.translate(LOWER) for t in TERM.findall(text or "")]) for i, text in docs]
    held = [(i, Counter(t), len(t)) for i, t in terms if t]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(t.translate(LOWER) for t in TERM.findall(text or ""))
    out = []
    for item, q in asked.items():
        found = []
        for i, c, n in held:
            m = 25 + 75 * n * count // total
            score = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def library():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    some = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(k, some(rng.randint(0, 120)).replace(" ", rng.choice([" ", "-", "\n"]))) for k in range(500)]
    docs += [(600 + k, docs[3][1]) for k in range(40)]  # ties
    docs += [(5, docs[5][1]), (None, docs[3][1]), (None, None), (700, None), (701, ""), (702, "?!"), (703, "A " * 3000), (-4, docs[3][1])]
    items = [(k, some(rng.randint(1, 30)).upper()) for k in range(25)] + [(25, docs[3][1]), (26, None), (27, "zzzz"), (28, "a a a b"), (28, "c"), (None, "a"), (29, "")]
    return docs, items


@pytest.mark.parametrize(("block", "terms"), [(lexical_search.BLOCK, lexical_search.MAX_TERMS), (64, lexical_search.MAX_TERMS), (200, 100)])
def test_search_equals_brute_force(spark, library, block, terms):
    docs, items = library
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tf int").repartition(3)
    got = lexical_search.ranked(df, spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, rank string"), block=block, max_terms=terms)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == searched(docs, items)


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 3000)
    docs = [np.unique(rng.zipf(1.3, s) % 60) for s in sizes]
    docs[1:1] = [docs[0]] * 400
    sizes = np.array([len(d) for d in docs])
    term, tf, m = np.concatenate(docs), rng.integers(1, 6, sizes.sum()), rng.integers(25, 400, len(docs))
    tf[: sizes[0]] = 9
    ids = rng.permutation(len(docs)).astype(np.int64)
    tree = lexical_search.Tree(ids, m, sizes, term, tf, leaf=16)
    assert all(hi - lo <= 16 or len({tuple(tree.term[tree.at[k] : tree.at[k + 1]]) for k in range(lo, hi)}) == 1 for (lo, hi), (a, b) in zip(tree.range, tree.kids, strict=True) if a == b)
    begin = np.cumsum(sizes) - sizes
    gain = lexical_search.weight(tf, np.repeat(m, sizes))
    for _ in range(60):
        wanted = np.zeros(60, dtype=np.int64)
        wanted[rng.integers(0, 60, 5)] = rng.integers(1, 9000, 5)
        score = np.add.reduceat(wanted[term] * gain, begin)
        order = np.lexsort((ids, -score))[:10]
        order = order[score[order] > 0]
        got = tree.search(wanted, (np.zeros(0, dtype=np.int64),) * 2, 10)
        assert got[0].tolist() == score[order].tolist() and got[1].tolist() == ids[order].tolist()


def test_search_of_empty_tables(spark, library):
    docs, items = library
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.ranked(df.limit(0), asked).count() == 0 and lexical_search.ranked(df, asked.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 7])
    assert lexical_search.lengths(n, 10**11, 10**14).tolist() == [25 + 75 * 10**20 // 10**14, 25 + 75 * 7 * 10**11 // 10**14]


# repeated bytes


def cut(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh éß日\x00") for _ in range(n))
    passage, line = some(90), some(55)
    rows = [(k, some(rng.randint(0, 300))) for k in range(60)]
    rows += [(100 + k, some(40) + passage + some(30)) for k in range(12)] + [(200 + k, some(20) + line + some(k)) for k in range(30)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, rows[1][1][:-1] + "x"), (2, rows[2][1] + "tail"), (None, rows[3][1]), (None, None), (302, None), (303, ""), (304, "ab" * 400), (305, some(30) + line + some(9) + line), (306, "z" * 49), (307, "y" * 50), (308, "x" * 51)]
    rows.append((309, some(3000) + passage + some(3000) + line))
    rows += [(310, "short"), (310, "short")]
    return rows


@pytest.mark.parametrize("more", [{}, {"max_group": 3, "shard": 900}, {"max_group": 1}, {"max_ids": 0, "max_group": 8}])
def test_repeats_equal_brute_force(spark, repeating, more):
    df = spark.createDataFrame([(*r, "k") for r in repeating], "doc_id long, text string, key string").repartition(3)
    got = suffix_dedup.without_repeats(df, 50, **more)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, *r) for (i, _), r in zip(repeating, cut([(t or "").encode() for _, t in repeating], 50), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(r[2] for r in want) > 3000


def test_long_texts_are_cut_into_pieces_that_share_their_ends(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(3210))
    windows = []
    for data, places in suffix_dedup._pieces(pa.array([b"", text, b"x" * 20], pa.binary()), 50):
        for row, at, begin, size in places:
            assert data[begin : begin + size].tobytes() == [b"", text, b"x" * 20][row][at : at + size]
            windows += [(row, at + i) for i in range(size - 49)]
    assert sorted(windows) == [(1, i) for i in range(3210 - 49)]


def test_repeats_of_an_empty_table(spark, repeating):
    df = spark.createDataFrame(repeating, "doc_id long, text string")
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_planted_passages_are_told_by_bytes_removed(spark, tmp_path):
    from soilspark.llm.queries import op13_repeated_bytes

    rng = random.Random(5)
    words = lambda n, least, most: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(least, most))) for _ in range(n))
    long, short, shouted = words(60, 8, 9), words(55, 4, 5), words(80, 8, 9)
    just = words(60, 8, 9)[:400]
    assert len(short) < 400 < len(long)
    rows = [(k, f"{words(40, 3, 9)} {k}{p}{k} {words(40, 3, 9)}") for k, p in enumerate([long, long, just, just, just[:399] + "z", short, short, "", "", shouted + "!" + shouted])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op13_repeated_bytes(spark, str(tmp_path)).collect())
    assert got == [(i, *r) for (i, _), r in zip(rows, cut([t.encode() for _, t in rows], 400), strict=True)]
    # n_bytes is the length of any document; passages below 400 bytes stay, and a document's own repeats go
    assert [r[2] for r in got] == [len(long), len(long), 400, 400, 0, 0, 0, 0, 0, 2 * len(shouted)]
    assert all(r[1] == len(t) for r, (_, t) in zip(got, rows, strict=True))


@pytest.mark.parametrize("few", [0, suffix_array.FEW])
def test_suffix_arrays_and_common_prefixes(few, monkeypatch):
    monkeypatch.setattr(suffix_array, "FEW", few)
    rng = random.Random(1)
    for _ in range(150):
        t = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 50))] * rng.choice([1, 1, 3])
        order = suffix_array.suffix_array(np.array(t, dtype=np.int16))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if len(t) > 1:
            common, before = suffix_array.common_prefixes(np.array(t, dtype=np.int16), order, np.array([0, len(t) // 2]), 400)
            for a, b in zip(order, order[1:], strict=False):
                n = 0
                while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert before[b] == a and common[b] == n


def test_large_rows_are_written_and_decoded_in_parts(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from soilspark.llm import storage

    seen = []
    real = spark.range(300, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.xxhash64(i, "id")).alias("value"))

    class Asked:
        sparkSession, schema = spark, real.schema

        @property
        def write(self):
            seen.append({spark.conf.get(c) for c in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")})
            return real.write

    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    back = storage.stored(Asked(), "large", 16)
    assert seen == [{"16"}] and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before
    path = back.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert sum(g.num_row_groups for g in groups) >= 3  # 72 MB
    assert back.count() == 300
