"""From raw documents to token ids: quality filter, near-dedup, surrogates for personal data, source mix, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm import bpe, common, mixing, pii, quality, simhash

#: Documents that score below go.
LEAST_QUALITY = 0.3
#: The key of the surrogates; a corpus that leaves the house takes a secret one.
PII_KEY = b"surrogates of the pipeline"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the rule ensemble is high enough; one document in five is never learnt from."""
    labels = common.read(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    score, = common.private(docs, "score_")
    scored = quality.fit(docs, labels).score(docs, name=score)
    return scored.filter(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints (SimHash of three-word shingles) differ in at most two bits.

    That is far less than a similarity of 0.8 over five words: most near copies stay (README).
    """
    return simhash.one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced, ``n_chars`` counted again."""
    out = pii.replace(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("pii", surrogates),
    ("mix", source_mix),
    ("bpe", encode),
]

#: XXH64, HMAC and the fitted rules have no counterpart in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
