"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrain.llm import (
    cover_tree,
    fingerprints,
    hard_negatives,
    licenses,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality,
    secrets,
    simhash_dedup,
    token_files,
    url_rules,
)
from voxgrain.llm.common import scratch, table

URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


def hexed(fp: str):
    """A signed long as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def held_out(key: str):
    """The rows no classifier may learn from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", hexed("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cover_tree.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.withColumnRenamed("component", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    found = quality.classify(table(spark, sf_dir, "documents"), labels, threshold=0.7)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.neighbour_report(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balance(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, low=50, high=95, scale=256)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in secrets.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "finds")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = prefix_trie.placed_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    rebuilt = prefix_trie.exchanged_heads(placed, conv - conv % 100, F.crc32(conv.cast("string")) % 6, most=5)
    return prefix_trie.nodes(rebuilt, placed.where("place = 0").select("conv"))


QUERIES = {
    f.__name__: f for f in (
        op1_packing, op2_simhash_dedup, op3_licenses, op4_pii, op5_cover_tree, op6_quality, op7_fingerprints, op8_mixing,
        op9_url_rules, op10_token_files, op11_hard_negatives,
        op12_secrets, op13_prefix_trie,
    )
}

# The operators use tokenizers, trained models, hashes or iteration, none of which SQL expresses;
# tests/llm holds each query against a brute-force version instead.
SQL: dict[str, str] = {}
