"""From raw documents to tokens, in five stages.

Each stage is a function of (spark, docs, sf_dir). It gets the rows that its predecessor
kept, read back from Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafclock.llm import bpe, minhash, mixing, quality_classifier, toxicity
from leafclock.sources.scratch import staged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text_sha256): the ids, and the digest of what they decode to.

    The ids are written once, so that a task has one Python worker at a time, not one for each direction.
    """
    encoded = staged(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), "encoded")
    decoded = bpe.decode(encoded, RANKS)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("near-dedup", near_dedup),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: The classifiers and the signatures are not SQL; tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
