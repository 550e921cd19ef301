"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

Null, empty and very short texts fail the quality rules, so later stages meet none in ``run``; given them, near-dedup links them
with each other, substring dedup keeps them, mixing leaves them out, and their encoding is empty. Long texts are worked on
whole. Null languages and sources are groups of their own; rows without doc_id, or of one doc_id with other texts, are documents of
their own; rows that repeat both are one document to near-dedup. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, mixing, quality, simhash, substring
from tesserae.llm.common import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the outlier estimates reject go."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return simhash.near_dedup(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one of 20 words or more are cut out of the texts; a text that loses words has those left joined by one space."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take, and those without words, go."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document in the mix, a row per copy."""
    return bpe.encode(docs, bpe.default_path())


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", keep_one_of_each_group),
    ("substring dedup", drop_repeats),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Fingerprints and token merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
