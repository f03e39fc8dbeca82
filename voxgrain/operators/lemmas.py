"""Lexicon lemmatiser: replace each word form by its lemma; forms it lacks by rules learned from it.

A rule says what to cut off and what to put in its place, after an ending. Every form of the lexicon
speaks for its own change after each of its endings, from the part that changes on; the change that
most forms with an ending have is the ending's rule. A form that is not in the lexicon follows the rule
of its longest known ending.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Union

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgrain.sources.files import materialize

Lexicon = Union[Mapping[str, str], DataFrame]

# A literal map is searched from front to back for each word, so only short lexicons
# are written into the expression; longer ones become a table.
LITERAL_ENTRIES = 200

# Tables up to this many bytes go through the driver to every executor; larger ones are
# joined, with the same result.
LOOKUP_BYTES = 8 * 1024 * 1024
ENTRY_BYTES = 32


LONGEST_ENDING = 6
MIN_FORMS = 2
MIN_STEM = 2


def _changes(lexicon: DataFrame) -> DataFrame:
    """(form, cut, put): letters to cut off a form's end, and what to put there, for its lemma."""
    shortest = F.least(F.length("form"), F.length("lemma"))
    lengths = F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(lengths, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("form", i, F.lit(1)) == F.substring("lemma", i, F.lit(1))), i).otherwise(n))
    told = lexicon.groupBy("form").agg(F.min("lemma").alias("lemma")).withColumn("_same", same)
    return told.select("form", (F.length("form") - F.col("_same")).alias("cut"), F.expr("substring(lemma, _same + 1)").alias("put"))


def ending_rules(lexicon: DataFrame, longest: int = LONGEST_ENDING, min_forms: int = MIN_FORMS) -> DataFrame:
    """(ending, cut, put, forms): the commonest change after each ending of up to ``longest`` letters.

    An ending holds the whole part that changes and leaves at least a letter before it; at least
    ``min_forms`` forms must have the change. Of equally common changes the one that cuts less
    counts, then the first in the order of what is put.
    """
    sizes = F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.least(F.lit(longest), F.length("form") - 1))
    fits = F.greatest(F.col("cut"), F.lit(1)) <= F.least(F.lit(longest), F.length("form") - 1)
    endings = _changes(lexicon).where(fits).select("cut", "put", F.explode(F.transform(sizes, lambda n: F.expr("form").substr(F.length("form") - n + 1, n))).alias("ending"))
    counted = endings.groupBy("ending", "cut", "put").agg(F.count(F.lit(1)).alias("forms")).where(F.col("forms") >= min_forms)
    best = F.min(F.struct((-F.col("forms")).alias("_less"), "cut", "put"))
    return counted.groupBy("ending").agg(best.alias("_best")).select("ending", "_best.cut", "_best.put", (-F.col("_best._less")).alias("forms"))


def lemmas_by_rule(forms: DataFrame, rules: DataFrame, form: str = "form", longest: int = LONGEST_ENDING) -> DataFrame:
    """(form, lemma) of the distinct ``forms`` that have a known ending and keep a stem of MIN_STEM letters."""
    single = forms.select(F.col(form).alias("form")).where(F.length("form") > 1).distinct()
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form") - 1))
    endings = single.select("form", F.explode(F.transform(sizes, lambda n: F.expr("form").substr(F.length("form") - n + 1, n))).alias("ending"))
    found = endings.join(rules, "ending").where(F.length("form") - F.col("cut") >= MIN_STEM)
    best = found.groupBy("form").agg(F.max(F.struct(F.length("ending").alias("size"), "cut", "put")).alias("_rule"))
    return best.select("form", F.concat(F.expr("substring(form, 1, length(form) - _rule.cut)"), F.col("_rule.put")).alias("lemma"))


def completed(df: DataFrame, text: str, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """The lexicon, and the lemmas by rule of the texts' words that it lacks; words without either stay away."""
    words = df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, " ")).alias("form")).distinct()
    unseen = words.join(lexicon.select("form"), "form", "left_anti")
    return lexicon.select("form", "lemma").unionByName(lemmas_by_rule(unseen, rules))


def lemmatize(df: DataFrame, text: str, output: str, key: str, lexicon: Lexicon | None) -> DataFrame:
    """Add ``output``: the words of a cleaned text, each replaced by its lemma if it has one.

    ``lexicon`` is a mapping form -> lemma or a DataFrame (form, lemma), of whose repeated
    forms the smallest lemma counts. Rows need no key of their own: ``key`` may be null or
    repeated. The table is computed once and measured: up to LOOKUP_BYTES it travels to the
    executors and no text is shuffled, else it is joined by shuffle, splitting skewed forms
    at run time. Null texts stay null.
    """
    if lexicon is None:
        return df.withColumn(output, F.col(text))
    if isinstance(lexicon, Mapping) and not lexicon:
        return df.withColumn(output, F.col(text))
    if isinstance(lexicon, Mapping) and len(lexicon) <= LITERAL_ENTRIES:
        return df.withColumn(output, _by_literal(text, lexicon))
    if isinstance(lexicon, Mapping):
        rows = [(form, lemma) for form, lemma in lexicon.items()]
        lexicon = df.sparkSession.createDataFrame(rows, "form string, lemma string")
    return _by_table(df, text, output, lexicon)


def _by_literal(text, lexicon):
    pairs = [F.lit(part) for entry in lexicon.items() for part in entry]
    table = F.create_map(*pairs)
    words = F.transform(F.split(text, " "), lambda word: F.coalesce(F.try_element_at(table, word), word))
    return F.array_join(words, " ")


def _by_table(df, text, output, lexicon):
    told = lexicon.where(F.col("form").isNotNull() & F.col("lemma").isNotNull())
    forms = materialize(told.groupBy(F.col("form").alias("_word")).agg(F.min("lemma").alias("_lemma")))
    size = forms.select(F.sum(F.octet_length("_word") + F.octet_length("_lemma") + ENTRY_BYTES)).first()[0]
    return (_by_lookup if (size or 0) <= LOOKUP_BYTES else _by_join)(df, text, output, forms)


def _replaced(text, lemmas):
    return " ".join([lemmas.get(word, word) for word in text.split(" ")])


def _by_lookup(df, text, output, forms):
    shared = df.sparkSession.sparkContext.broadcast({r["_word"]: r["_lemma"] for r in forms.collect()})

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else _replaced(t, shared.value) for t in batch], dtype=object)

    return df.withColumn(output, replace(F.col(text)))


def _by_join(df, text, output, forms):
    """Lemmas of every distinct text, found again by the text's digest, so keys do not matter.

    A text sends each of its words once, and gets back those that have a lemma.
    """
    digest = F.unhex(F.sha2(text, 256))
    texts = df.where(F.col(text).isNotNull()).groupBy(digest.alias("_digest")).agg(F.first(text).alias("_text"))
    words = texts.select("_digest", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
    told = words.join(forms, "_word").groupBy("_digest").agg(F.collect_list(F.struct("_word", "_lemma")).alias("_told"))

    @F.pandas_udf("string")
    def replace(texts: pd.Series, words: pd.Series, lemmas: pd.Series) -> pd.Series:
        rows = (t if t is None or w is None else _replaced(t, dict(zip(w, m))) for t, w, m in zip(texts, words, lemmas))
        return pd.Series(list(rows), dtype=object)

    joined = df.join(told, digest == told["_digest"], "left")
    return joined.withColumn(output, replace(F.col(text), F.col("_told._word"), F.col("_told._lemma"))).drop("_digest", "_told")
