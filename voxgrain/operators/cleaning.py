"""Cleaning, validity and exact repeats of post texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.functions.stats import count_where, percent
from voxgrain.operators.lemmas import Lexicon, lemmatize
from voxgrain.operators.ranking import first_per_key

# Accepted lengths of a cleaned text, in characters, both included.
MIN_LENGTH = 10
MAX_LENGTH = 300


def validity(
    cleaned: Column,
    min_length: int = MIN_LENGTH,
    max_length: int = MAX_LENGTH,
    language_ok: Column | None = None,
    strict: bool = False,
) -> Column:
    """Length and language test of a cleaned text.

    Without a language test every text is valid whatever its length; ``strict``
    enforces the length in that case as well.
    """
    long_enough = tx.length_between(cleaned, min_length, max_length)
    if language_ok is not None:
        return long_enough & F.coalesce(language_ok, F.lit(False))
    return long_enough if strict else F.lit(True)


def process_posts(
    df: DataFrame,
    text: str = "text",
    key: str = "id",
    min_length: int = MIN_LENGTH,
    max_length: int = MAX_LENGTH,
    language_ok: Column | None = None,
    strict: bool = False,
    lexicon: Lexicon | None = None,
    keep_invalid: bool = False,
) -> DataFrame:
    """Add original, cleaned, lemmatized, is_valid and length; keep the valid rows.

    ``language_ok`` is a boolean Column over ``df`` (say, a detected language compared
    with the wanted one). Texts are lemmatised only where they are valid; without a
    lexicon the cleaned text stands for its lemmas.

    The language test comes first, as a predicate of its own that can reach the scan. The
    cleaned text is made by exploding an array of one, which the length test is not pushed
    through, so each text is cleaned once.
    """
    if language_ok is not None and not keep_invalid:
        df, language_ok, strict = df.where(language_ok), None, True
    cleaned = df.withColumn("original", F.col(text)).withColumn("cleaned", F.explode(F.array(tx.clean_text(text))))
    valid = validity(F.col("cleaned"), min_length, max_length, language_ok, strict)
    marked = cleaned.withColumn("is_valid", valid).withColumn("length", F.length("cleaned"))
    if not keep_invalid:
        marked = marked.where("is_valid")
    marked = lemmatize(marked, "cleaned", "lemmatized", key, lexicon)
    return marked.withColumn("lemmatized", F.when(F.col("is_valid"), F.col("lemmatized")).otherwise(F.lit("")))


def processing_stats(df: DataFrame, language_ok: Column | None = None) -> DataFrame:
    """One row: texts, valid texts, mean lengths, and texts in or out of the language."""
    measures = [
        F.count(F.lit(1)).alias("total_texts"),
        count_where(F.col("is_valid")).alias("valid_texts"),
        F.avg(F.length("original")).alias("avg_length_original"),
        F.avg(F.length("cleaned")).alias("avg_length_cleaned"),
        F.avg(F.length("lemmatized")).alias("avg_length_lemmatized"),
    ]
    if language_ok is not None:
        told = F.coalesce(language_ok, F.lit(False))
        measures += [
            count_where(told).alias("in_language"),
            count_where(~told).alias("not_in_language"),
        ]
    return df.agg(*measures)


def before_after(df: DataFrame) -> DataFrame:
    """Mean length before and after cleaning, kept rows and approval rate in percent.

    ``df`` carries text, cleaned and is_valid for all rows, valid or not.
    """
    valid = F.col("is_valid")
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        count_where(valid).alias("rows_after"),
        F.avg(F.length("original")).alias("avg_length_before"),
        F.avg(F.when(valid, F.length("cleaned"))).alias("avg_length_after"),
        percent(count_where(valid), F.count(F.lit(1))).alias("approval_pct"),
    )


def _digest(text: str) -> Column:
    """Digest of a text; null has one of its own."""
    return F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")), 256)


def drop_repeats(df: DataFrame, text: str = "lemmatized", key: str = "id") -> DataFrame:
    """Keep the row with the smallest key of each group of equal texts.

    Rows are grouped and sorted by digest, and each task sends one row per digest.
    """
    return first_per_key(df.withColumn("_digest", _digest(text)), ["_digest"], [F.col(key)]).drop("_digest")


def repeat_counts(df: DataFrame, text: str = "lemmatized") -> DataFrame:
    """One row: rows, rows kept and rows removed by dropping repeats.

    Groups are counted by digest, so whole texts are not shuffled.
    """
    groups = df.groupBy(_digest(text).alias("_digest")).count()
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"),
    )


def filled_only(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return df.where(tx.is_filled(text))
