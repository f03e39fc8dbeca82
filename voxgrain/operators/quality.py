"""Data quality: missing values, repeats, coverage, scores, verdict, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgrain.functions.stats import count_where, percent
from voxgrain.functions.text import is_filled
from voxgrain.operators.profiling import elapsed_days

# Divisors and caps of the scores, levels of the verdicts, and the
# thresholds and wording of the advice.
RICHNESS_CHARS = 100
COVERAGE_DAYS = 30
DIVERSITY_STD = 10
SCORE_CAP = 100.0
METRIC_LEVELS = ((70, "good"), (40, "fair"))
VERDICT_LEVELS = ((80, "EXCELLENT"), (60, "GOOD"), (40, "MODERATE"))
LOWEST_METRIC, LOWEST_VERDICT = "poor", "POOR"
WANTED_POSTS = 1000
WANTED_DAYS = 7
ADVICE_POSTS = "Consider collecting more posts (target: 1000+)"
ADVICE_DAYS = "Extend temporal coverage (target: 7+ days)"
ADVICE_REPEATS = "Remove duplicate entries"


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, missing, pct) of the columns that lack values, from one aggregate."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_where(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing"), percent(f"m_{c}", "_rows").alias("pct")
        )
        for c in df.columns
    ]
    return counted.select(F.inline(F.array(*entries))).where(F.col("missing") > 0)


def repeat_counts(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """(kind, repeats): rows beyond the first per key, for several keys in one scan.

    Each row sends one digest per kind, combined before the shuffle. Nulls count as equal.
    Values are written with their length, so that neighbours cannot run together, and times
    to the microsecond.
    """
    value = lambda c: F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
    digest = lambda columns: F.sha2(F.concat(*[F.coalesce(value(c), F.lit("null")) for c in columns]), 256)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), digest(c).alias("digest")) for k, c in keys.items()])
    groups = df.select(F.inline(kinds)).groupBy("kind", "digest").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("kind").agg(F.sum(F.col("n") - 1).alias("repeats"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, filled, pct, avg_length) of text columns; lengths of filled texts."""
    measures = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        measures += [count_where(is_filled(c)).alias(f"f_{c}"), F.avg(F.when(is_filled(c), F.length(c))).alias(f"l_{c}")]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"f_{c}").alias("filled"),
            percent(f"f_{c}", "_rows").alias("pct"), F.col(f"l_{c}").alias("avg_length"),
        )
        for c in columns
    ]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def quality_scores(df: DataFrame, text: str = "text", timestamp: str = "timestamp", score: str = "score") -> DataFrame:
    """(metric, score) from one aggregate; metrics whose column is absent are left out."""
    nulls = [count_where(F.col(c).isNull()) for c in df.columns]
    missing = nulls[0]
    for count in nulls[1:]:
        missing = missing + count
    measures = [F.count(F.lit(1)).alias("_rows"), missing.alias("_missing")]
    cap = lambda value: F.least(value, F.lit(SCORE_CAP))
    metrics = {
        "completeness": (F.lit(1.0) - F.try_divide(F.col("_missing"), F.col("_rows") * len(df.columns))) * 100.0
    }
    if text in df.columns:
        measures.append(F.avg(F.length(text)).alias("_length"))
        metrics["content_richness"] = cap(F.col("_length") / RICHNESS_CHARS)
    if timestamp in df.columns:
        measures += [F.min(timestamp).alias("_first"), F.max(timestamp).alias("_last")]
        metrics["temporal_coverage"] = cap(elapsed_days(F.col("_first"), F.col("_last")) / F.lit(float(COVERAGE_DAYS)) * 100)
    if score in df.columns:
        measures.append(F.stddev_samp(score).alias("_std"))
        metrics["engagement_diversity"] = cap(F.col("_std") / DIVERSITY_STD)
    entries = [F.struct(F.lit(name).alias("metric"), value.alias("score")) for name, value in metrics.items()]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def _level(value, levels, lowest):
    named = F.lit(lowest)
    for least, name in reversed(levels):
        named = F.when(value > least, F.lit(name)).otherwise(named)
    return named


def quality_verdict(scores: DataFrame) -> DataFrame:
    """(metric, score, status): each metric, then the mean of all with the verdict."""
    single = scores.select("metric", "score", _level(F.col("score"), METRIC_LEVELS, LOWEST_METRIC).alias("status"))
    overall = scores.agg(F.avg("score").alias("score")).select(
        F.lit("overall").alias("metric"), "score", _level(F.col("score"), VERDICT_LEVELS, LOWEST_VERDICT).alias("status")
    )
    return single.unionByName(overall)


def recommendations(df: DataFrame, timestamp: str = "timestamp", keys: Sequence[str] | None = None) -> DataFrame:
    """(advice) rows for too few posts, too few days, and repeated rows.

    Without a time column there is no advice on days.
    """
    repeats = repeat_counts(df, {"rows": list(keys or df.columns)}).select("repeats").scalar()
    measures, advice = [F.count(F.lit(1)).alias("n")], [F.when(F.col("n") < WANTED_POSTS, F.lit(ADVICE_POSTS))]
    if timestamp in df.columns:
        measures += [F.min(timestamp).alias("first"), F.max(timestamp).alias("last")]
        advice.append(F.when(elapsed_days(F.col("first"), F.col("last")) < WANTED_DAYS, F.lit(ADVICE_DAYS)))
    advice.append(F.when(repeats > 0, F.lit(ADVICE_REPEATS)))
    return df.agg(*measures).select(F.explode(F.array_compact(F.array(*advice))).alias("advice"))
