"""Sentiment labels: codes, weak labels, samples, folds and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgrain.functions.sampling import DEFAULT_SEED, DRAW_RANGE, draw
from voxgrain.functions.text import WORD, as_column
from voxgrain.functions.word_lists import MANY_WORDS, found_words
from voxgrain.operators.ranking import number_within

# Classes with their codes, the words of the weak labels, the odds of a
# label where the words are undecided, sizes of the labelled sample and the smallest
# training set.
CLASSES = ("negative", "neutral", "positive")
POSITIVE_WORDS = ("bom", "ótimo", "excelente", "positivo", "benefício", "melhora", "sucesso")
NEGATIVE_WORDS = ("ruim", "péssimo", "horrível", "negativo", "problema", "erro", "fracasso", "preocupado")
UNDECIDED_ODDS = (("neutral", 0.6), ("positive", 0.2), ("negative", 0.2))
SAMPLE_SIZE = 600
MIN_TRAINING_ROWS = 50


def label_code(label: Column | str, strict: bool = True) -> Column:
    """negative, neutral, positive -> 0, 1, 2. An unknown label is an error, or null if not strict."""
    label = as_column(label)
    code = F.lit(None).cast("int")
    if strict:
        message = F.concat(F.lit("unknown label: "), label.cast("string"))
        code = F.when(label.isNotNull(), F.raise_error(message).cast("int"))
    for number, name in reversed(list(enumerate(CLASSES))):
        code = F.when(label == name, F.lit(number)).otherwise(code)
    return code


def label_name(code: Column | str) -> Column:
    """0, 1, 2 -> negative, neutral, positive; anything else is null."""
    code = as_column(code)
    name = F.lit(None).cast("string")
    for number, known in reversed(list(enumerate(CLASSES))):
        name = F.when(code == number, F.lit(known)).otherwise(name)
    return name


def word_hits(text: Column | str, words: Sequence[str], whole_words: bool = False) -> Column:
    """How many of the words occur in the text, each counted once."""
    lowered = F.lower(as_column(text))
    if len(words) > MANY_WORDS and not whole_words:
        return F.when(lowered.isNotNull(), F.size(found_words(lowered, words)))
    hits = F.lit(0)
    for word in words:
        if whole_words:
            found = F.regexp_like(lowered, F.lit(rf"(?<![{WORD}])\Q{word}\E(?![{WORD}])"))
        else:
            found = F.contains(lowered, F.lit(word))
        hits = hits + found.cast("int")
    return hits


def weak_label(
    text: Column | str,
    key: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    seed: int = DEFAULT_SEED,
    whole_words: bool = False,
) -> Column:
    """Label by word lists; a tie is drawn by the row's key at fixed odds."""
    good = word_hits(text, positive, whole_words)
    bad = word_hits(text, negative, whole_words)
    chance = draw(key, seed)
    drawn, edge = F.lit(UNDECIDED_ODDS[-1][0]), 1.0
    for name, odds in reversed(UNDECIDED_ODDS):
        drawn = F.when(chance < F.lit(round(edge * DRAW_RANGE)), F.lit(name)).otherwise(drawn)
        edge -= odds
    return F.when(good > bad, F.lit("positive")).when(bad > good, F.lit("negative")).otherwise(drawn)


def seeded_sample(df: DataFrame, key: str, size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """min(size, rows) rows, the same ones on every run and cluster."""
    return df.withColumn("_draw", draw(key, seed)).orderBy("_draw", key).limit(size).drop("_draw")


def labelled_sample(df: DataFrame, key: str, text: str = "lemmatized", size: int = SAMPLE_SIZE, **options) -> DataFrame:
    """A seeded sample with a weak ``sentiment`` label."""
    return seeded_sample(df, key, size).withColumn("sentiment", weak_label(text, key, **options))


def labelled_only(df: DataFrame, text: str = "lemmatized", label: str = "sentiment") -> DataFrame:
    """Rows with text and label, and the code of the label in ``label_code``."""
    return df.dropna(subset=[text, label]).withColumn("label_code", label_code(label))


def class_distribution(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def enough_rows(df: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    """One row: the row count and whether it suffices for training."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= minimum)


def require_rows(df: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> None:
    """Raise unless there are ``minimum`` rows; at most that many are read."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"not enough rows to train: {found}, at least {minimum} needed")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1, shuffled and of equal size within each class."""
    numbered = number_within(df.withColumn("_draw", draw(key, seed)), [label], "_draw", key, "_number")
    return numbered.withColumn("fold", F.pmod(F.col("_number") - 1, F.lit(folds)).cast("int")).drop("_number", "_draw")


def stratified_split(
    df: DataFrame, label: str, key: str, validation: float = 0.2, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``is_validation``, true for the given share of each class."""
    drawn = df.withColumn("_draw", draw(key, seed))
    numbered = number_within(drawn, [label], "_draw", key, "_number", total="_total")
    wanted = F.floor(F.col("_total") * validation + 0.5)
    return numbered.withColumn("is_validation", F.col("_number") <= wanted).drop("_number", "_total", "_draw")
