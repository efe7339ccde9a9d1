"""The corpus pipeline: language ID, near-dedup, PII, mixing, SentencePiece ids.

Defined cases of every stage: an empty table stays empty; other columns than those of documents are left behind; ids may be null or repeat,
and repeated rows are documents each until near-dedup keeps one of them; texts may be of any length that a row can have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.llm import language_id, minhash, mixing, pii, sentencepiece_codec
from terrazone.session import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null texts and those without a letter go."""
    return language_id.keep_identified(docs.select(*COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id; texts without words, which language ID leaves none of, all stay."""
    return minhash.keep_one(docs.select(*COLUMNS))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows. No document goes; null texts stay null."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, shuffled; a null source is one of its own. Some are drawn no times."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding; a null text has none."""
    import public_tokenizers

    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", identify), ("MinHash near-dedup", deduplicate), ("PII", sanitise), ("mixing", mix), ("SentencePiece", encode)]

#: Learned models and similarity search aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
