"""Queries op1 to op13, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrazone.llm import chat, collocations, context_mixing, fingerprint, language_id, minhash, mixing, multi_index, pii, resampling, sentencepiece_codec, token_counts, url_filter
from terrazone.session import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.with_calls(table(spark, sf_dir, "conversations")))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_chat_formatting, op3_embedding_links, op4_mixing, op5_token_counts, op6_language_id, op7_url_filters, op8_sentencepiece, op9_fingerprints, op10_pii, op11_collocations, op12_resampling, op13_lm_scoring)
}
ORACLES = {"op2_chat_formatting": chat.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op7_url_filters": url_filter.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL}
