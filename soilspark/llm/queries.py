"""The queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soilspark.llm import bagminhash, collocations, decontaminate, fingerprint, html_extract, lexical_search, packing, secret_scan, sharding, suffix_dedup, toxicity, url_filter, warc
from soilspark.llm.storage import scratch

SHARDS = 64


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return sharding.placed(docs, "doc_id", sharding.shard_names(SHARDS))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.resolved(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    back = warc.read_archives(spark, path, payload=False, verify=True)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.main_text(pages, html_extract.train(pages))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.judged(docs.select("doc_id", "text"), toxicity.train(docs, labels)).drop("text")


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.contamination(docs, benchmark)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search.ranked(docs, benchmark)


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_url_verdicts": op3_url_verdicts,
    "op4_shard_documents": op4_shard_documents,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_secrets": op6_secrets,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_windows": op9_benchmark_windows,
    "op10_fingerprints": op10_fingerprints,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_repeated_bytes": op13_repeated_bytes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_shard_documents": sharding.oracle_sql("documents", "doc_id", sharding.shard_names(SHARDS)),
    "op5_warc_round_trip": warc.ORACLE_SQL,
    "op9_benchmark_windows": decontaminate.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_ranked_search": lexical_search.ORACLE_SQL,
}
