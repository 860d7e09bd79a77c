"""Registry of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm import audit, exact, fertility, langid, minhash, mixing, packing, pii, substrings, suffixes, urls, variants, vectors
from docstrata.llm.common import documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(documents(spark, sf_dir)).drop("dk", "rid", "first")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(documents(spark, sf_dir)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir), file_backed=True).drop("at")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(documents(spark, sf_dir)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.without_repeats(documents(spark, sf_dir)))


def op11_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_personal_data": op2_personal_data,
    "op3_mix_sources": op3_mix_sources,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_language": op9_language,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_fertility": op11_token_fertility,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    "op3_mix_sources": mixing.MIX_SQL,
    "op5_exact_dedup": exact.EXACT_SQL,
    "op7_url_filter": urls.URLS_SQL,
    "op12_filter_audit": audit.AUDIT_SQL,
}
