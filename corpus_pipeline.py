"""From raw documents to token ids: quality, toxicity, near-duplicates, source mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribospark.llm import bpe, mixing, quality, simhash, toxicity
from tribospark.llm.text import fold
from tribospark.session import materialise


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts; it learns from two thirds of the labelled ones."""
    model = quality.fit(docs, _labels(spark, sf_dir), fold(F.col("doc_id"), 3) != 1)
    return docs.where(quality.score_of(F.col("text"), model) >= 0.5)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxic passages make them toxic; learns from four fifths of the labelled ones."""
    model = toxicity.fit(docs, _labels(spark, sf_dir), fold(F.col("doc_id"), 5) != 0)
    return docs.where(toxicity.score_of(F.col("text"), model) < 0.5)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(docs, vocabulary, keep_text=False, decoded="decoded").select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", no_near_copies),
    ("mixing", mixed),
    ("BPE", tokens),
]
#: The stages can't be written in SQL; tests compare the run with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
