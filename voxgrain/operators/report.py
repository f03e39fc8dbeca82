"""Aggregates behind the sentiment report: totals, timelines, platforms, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgrain.functions.sampling import DEFAULT_SEED, draw
from voxgrain.functions.stats import count_where, percent, percent_tenths
from voxgrain.functions.text import shorten
from voxgrain.operators.labels import CLASSES
from voxgrain.operators.profiling import histogram
from voxgrain.operators.ranking import counted_quantiles, keep_top
from voxgrain.sources.files import materialize

# Order of the classes in the report, confidence levels, and the number of
# confidence bins.
REPORT_ORDER = ("positive", "neutral", "negative")
HIGH_CONFIDENCE = 0.8
LOW_CONFIDENCE = 0.5
CONFIDENCE_BINS = 20
ALL_PLATFORMS = "all"
NOT_AVAILABLE = "N/A"


def for_platform(df: DataFrame, platform: str = ALL_PLATFORMS) -> DataFrame:
    return df if platform == ALL_PLATFORMS else df.where(F.col("platform") == platform)


def at_least(df: DataFrame, confidence: float) -> DataFrame:
    """Rows of at least this confidence; all rows if there is no such column."""
    return df.where(F.col("confidence") >= confidence) if "confidence" in df.columns else df


def key_figures(df: DataFrame, sentiment: str = "predicted_sentiment") -> DataFrame:
    """One row: posts and the share of each class to one decimal; zeros without posts."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_posts"), *[count_where(F.col(sentiment) == c).alias(f"_{c}") for c in REPORT_ORDER]
    )
    return counted.select("total_posts", *[percent_tenths(f"_{c}", "total_posts").alias(f"{c}_pct") for c in REPORT_ORDER])


def hourly_sentiment(df: DataFrame, timestamp: str = "timestamp", sentiment: str = "predicted_sentiment") -> DataFrame:
    return df.groupBy(F.date_trunc("hour", timestamp).alias("hour"), sentiment).agg(F.count(F.lit(1)).alias("n"))


def platform_matrix(df: DataFrame, sentiment: str = "predicted_sentiment", platform: str = "platform") -> DataFrame:
    """Posts per platform and class, with the total and the share of each class in percent."""
    counted = df.groupBy(platform).agg(
        *[count_where(F.col(sentiment) == c).alias(c) for c in CLASSES], F.count(sentiment).alias("total")
    )
    return counted.select("*", *[percent(c, "total").alias(f"{c}_pct") for c in CLASSES])


def platform_shares(df: DataFrame, sentiment: str = "predicted_sentiment", platform: str = "platform") -> DataFrame:
    """(platform, sentiment, pct): class shares per platform, summing to 100."""
    matrix = platform_matrix(df, sentiment, platform)
    rows = F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(f"{c}_pct").alias("pct")) for c in REPORT_ORDER])
    return matrix.select(platform, F.inline(rows))


def confidence_histogram(df: DataFrame) -> DataFrame:
    """Counts in 20 bins of width 0.05 over [0, 1]."""
    return histogram(df, "confidence", CONFIDENCE_BINS, 0.0, 1.0)


def sentiment_shares(df: DataFrame, sentiment: str = "predicted_sentiment") -> DataFrame:
    """(sentiment, n, pct) over all rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    counted = df.where(F.col(sentiment).isNotNull()).groupBy(sentiment).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(sentiment, "n", percent("n", total).alias("pct"))


def sample_per_class(
    df: DataFrame, key: str, rows: int = 5, sentiment: str = "predicted_sentiment", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Up to ``rows`` reproducible random rows per class, with the place of the class in the report."""
    drawn = df.where(F.col(sentiment).isin(*CLASSES)).withColumn("_draw", draw(key, seed))
    kept = keep_top(drawn, [sentiment], [F.col("_draw"), F.col(key)], rows, key, rank="sample_place").drop("_draw")
    place = F.array_position(F.array(*[F.lit(c) for c in REPORT_ORDER]), F.col(sentiment))
    return kept.withColumn("class_place", place.cast("int"))


def display_rows(sample: DataFrame, key: str, text: str = "lemmatized", sentiment: str = "predicted_sentiment") -> DataFrame:
    """Sample rows as shown: cut texts, times to the minute, two decimals, N/A for nulls."""
    shown = lambda column: F.coalesce(column, F.lit(NOT_AVAILABLE))
    confidence = F.format_string("%.2f", F.round("confidence", 2)) if "confidence" in sample.columns else F.lit(None).cast("string")
    if "confidence" in sample.columns:
        confidence = F.when(F.col("confidence").isNotNull(), confidence)
    return sample.select(
        key, "class_place", "sample_place",
        shown(F.col("platform")).alias("platform") if "platform" in sample.columns else F.lit(NOT_AVAILABLE).alias("platform"),
        F.col(sentiment).alias("sentiment"),
        shown(confidence).alias("confidence"),
        shorten(text).alias("text"),
        shown(F.date_format("timestamp", "yyyy-MM-dd HH:mm")).alias("time"),
    )


def prediction_stats(df: DataFrame) -> DataFrame:
    """One row: predictions per class and share, confidence summary, high and low counts.

    The rows are read once, to count each confidence of each class; every figure comes
    from these counts.
    """
    value, n = F.col("confidence"), F.col("n")
    counts = materialize(df.groupBy("confidence", "predicted_sentiment").agg(F.count(F.lit(1)).alias("n")))
    given = counts.where(value.isNotNull()).groupBy("confidence").agg(F.sum("n").alias("n"))
    quartiles = counted_quantiles(given, "confidence", (0.25, 0.5, 0.75)).select(F.struct("q25", "q50", "q75")).scalar()
    mean = given.select(F.try_divide(F.sum(value * n), F.sum("n"))).scalar()
    having = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    filled = having(value.isNotNull())
    counted = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        *[having(F.col("predicted_sentiment") == c).alias(c) for c in CLASSES],
        mean.alias("avg_confidence"),
        F.when(filled > 1, F.sqrt(F.try_divide(F.sum(n * (value - mean) ** 2), filled - 1))).alias("std_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        having(value > HIGH_CONFIDENCE).alias("high_confidence"),
        having(value < LOW_CONFIDENCE).alias("low_confidence"),
    )
    return counted.select(
        "*", *[percent(c, "total_predictions").alias(f"{c}_pct") for c in CLASSES],
        *[quartiles.getField(q).alias(f"{q}_confidence") for q in ("q25", "q50", "q75")],
    )
