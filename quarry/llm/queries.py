"""The registered queries of this subpackage: thin calls of its operators over
whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe_codec, language, lexical, licenses, mips, neardup, packing, quality, segments, setjoin, sstable, token_counts, upsert
from quarry.llm.common import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=1, folds=3)


def op3_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(spark, table(spark, sf_dir, "documents"), vocab="word_bpe_49k.json", end_id=1)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), fold=2, folds=4)


def op8_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, window=2048)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_copy_on_write_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_clients(spark, table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe_round_trip, op2_quality_classifier, op3_token_id_shards, op4_license_scan, op5_embedding_near_duplicates, op6_ngram_jaccard_join, op7_language_id, op8_inner_product_search, op9_token_counts, op10_lexical_packing, op11_ranked_lexical_search, op12_copy_on_write_upsert, op13_exact_top_k)
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.oracle(),
    "op5_embedding_near_duplicates": neardup.oracle(least=0.95),
    "op6_ngram_jaccard_join": setjoin.oracle(k=4, num=85, den=100),
    "op11_ranked_lexical_search": lexical.oracle(k=10),
    "op13_exact_top_k": segments.oracle(every=50, k=5, scale=256),
}
