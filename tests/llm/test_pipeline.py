"""The pipeline's stages against brute force, on planted documents."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = some(30)
    rows = [[i, some(rng.randint(30, 120)), "en", "s", None] for i in range(120)]
    for i in range(0, 60, 2):
        rows[i][1] += " zgrumf vlaxot zgrumf"
    rows[101][1] = rows[61][1]
    rows[103][1] = rows[63][1] + " tail"
    rows[105][1] += " " + item
    rows[107][1] += ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end'
    for r in rows:
        r[4] = len(r[1])
    rows += [[200, None, None, None, None], [201, "", "en", "s", 0]]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages(spark, folder, tmp_path):
    assert NAMES == ["toxicity", "near duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    every = set(range(120)) | {200, 201}
    assert set(kept[0]) == every - set(range(0, 60, 2))
    assert set(kept[1]) == set(kept[0]) - {101, 103, 201}
    assert set(kept[2]) == set(kept[1]) - {105}
    assert set(kept[3]) == set(kept[2]) and kept[3][107].endswith('token = "[secret]" end')
    assert all(kept[3][i] == kept[2][i] for i in kept[2] if i != 107)
    assert {r["doc_id"] for r in docs.collect()} == set(kept[3])


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_over_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_intermediate_tables_can_be_deleted(spark):
    import os

    from soilspark.llm import storage

    df = storage.stored(spark.range(3), "x")
    path = storage._written[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert storage.forget(spark) > 0 and not os.path.isdir(path)
