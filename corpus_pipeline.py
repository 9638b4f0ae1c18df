"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Rows with null or empty texts pass through every stage (as empty
documents) unless the classifier rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, quality, simhash, suffix_dedup
from tidemark.llm.common import documents, table, unused


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of at least its threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "_quality")
    scored = quality.score(docs, model, name=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by fingerprints within two bits or by shingles.

    Shingles are five words and texts that share 0.8 of them or more are alike.
    """
    return simhash.keep_one(docs, similarity=simhash.SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that stand in another document too."""
    return _with_size(suffix_dedup.remove_repeats(docs, repeats=suffix_dedup.PASSAGES))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of personal data in the place of it."""
    return _with_size(pii.redact(docs, pii.train(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", redact_personal),
    ("packing", pack_sequences),
]

#: Training, hashing and tokenizing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
