"""Corpus cleaning as five stages over documents, each one of the corpus operators.

Every stage takes an empty table (and gives one), extra columns (and drops them), repeated
rows and ids, null ids, and very long texts, which are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import packing, rules, secrets, simhash, suffixes
from bookloom.operators.common import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.  Null and empty texts have no words: they go
    too.  Repeated rows are judged alike."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, null ids
    last.  Null and empty texts are one group; repeated rows are in one group."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out of the texts.  Texts
    without a copy stay as they are, null ones too; one with nothing but blanks left goes."""
    return suffixes.cut_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a marker.  Null texts stay null; repeated rows are
    masked alike."""
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token pieces in full sequences.  Null texts count as empty; repeated
    rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("suffix_dedup", passage_dedup),
          ("secret_scan", without_secrets), ("best_fit_packing", packed)]

#: Near-duplicate groups, passages and packing have no plain SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if place + 1 < len(STAGES):
            out = settle(out, name)
    return out
