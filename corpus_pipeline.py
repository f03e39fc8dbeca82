"""The corpus pipeline: from all documents to packed token sequences, stage by stage."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxgrain.llm import mixing, packing, pii, quality, shingle_dedup, simhash_dedup
from voxgrain.llm.common import stored, table
from voxgrain.llm.queries import held_out


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of four bits' difference, or by shingles of five words and similarity 0.8."""
    by_shingles = partial(shingle_dedup.near_duplicates, words=5, likeness=0.8)
    return simhash_dedup.keep_one(docs, find=simhash_dedup.united, finds=(simhash_dedup.near_duplicates, by_shingles))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [("quality", good), ("near duplicates", distinct), ("personal data", private), ("mixing", mixed), ("packing", packed)]

# Trained models, hashes and tokenizers are not SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
