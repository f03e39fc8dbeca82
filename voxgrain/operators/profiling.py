"""Profiles of post datasets: lengths, dates, platforms, terms, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.functions import text as tx
from voxgrain.functions.sampling import DEFAULT_SEED, draw
from voxgrain.functions.stats import count_where, percent
from voxgrain.operators.profiles import exact_quantiles, profile
from voxgrain.operators.ranking import bounded_quantiles
from voxgrain.sources.files import materialize

# Name parts that mark text and date columns, platform column names in
# order of preference, and the thresholds of the length report.
TEXT_NAMES = ("text", "content", "body", "title", "tweet", "post")
DATE_NAMES = ("date", "created_at", "timestamp", "time")
PLATFORM_NAMES = ("platform", "source", "file_source")
MIN_MEAN_TEXT_LENGTH = 20
SHORT_LENGTH = 10
LONG_LENGTH = 1000
WHISKER = 1.5
QUARTILES = (0.25, 0.5, 0.75)
SECONDS_PER_DAY = 86400


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def detect_columns(df: DataFrame) -> DataFrame:
    """(role, column_name, place) of the text, date and platform columns found.

    Text columns are told by name; if no name fits, string columns with a mean length
    above 20 are taken, from one aggregate over all of them. Date columns must also be
    castable to a timestamp.
    """
    named = [c for c in df.columns if any(part in c.lower() for part in TEXT_NAMES)]
    dates = [
        f.name
        for f in df.schema
        if any(part in f.name.lower() for part in DATE_NAMES)
        and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
    ]
    platform = [c for c in PLATFORM_NAMES if c in df.columns][:1]
    candidates = named or _string_columns(df)
    measures = [F.avg(F.length(c)).alias(f"len_{c}") for c in candidates if not named]
    strings = set(_string_columns(df))
    castable = [
        (F.count(F.try_to_timestamp(c)) == F.count(c) if c in strings else F.lit(True)).alias(f"date_{c}") for c in dates
    ]
    entry = lambda role, name, place, ok: F.when(
        ok, F.struct(F.lit(role).alias("role"), F.lit(name).alias("column_name"), F.lit(place).alias("place"))
    )
    entries = [
        entry("text", c, i, F.lit(True) if named else F.col(f"len_{c}") > MIN_MEAN_TEXT_LENGTH)
        for i, c in enumerate(candidates)
    ]
    entries += [entry("date", c, i, F.col(f"date_{c}")) for i, c in enumerate(dates)]
    entries += [entry("platform", c, i, F.lit(True)) for i, c in enumerate(platform)]
    measured = df.agg(F.count(F.lit(1)).alias("_n"), *measures, *castable)
    return measured.select(F.inline(F.array_compact(F.array(*entries))))


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    return df.orderBy(key).limit(rows)


def column_overview(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null) per column, from one aggregate."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entry = lambda f: F.struct(
        F.lit(f.name).alias("column_name"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.col(f.name).alias("non_null"),
    )
    return counted.select(F.inline(F.array(*[entry(f) for f in df.schema])))


def with_length(df: DataFrame, text: str, name: str = "text_length") -> DataFrame:
    return df.withColumn(name, F.length(text))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of a whole-number column."""
    quartiles = bounded_quantiles(df, value, QUARTILES)
    basic = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    found = quartiles.select(F.struct("q25", "q50", "q75")).scalar()
    return basic.select("*", *[found.getField(q).alias(q) for q in ("q25", "q50", "q75")])


def histogram(df: DataFrame, value: str, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, low, high, n) for non-empty bins of equal width; the last bin is closed.

    Without given bounds the range is the scalar minimum and maximum of the column, whose values are
    then made once and kept.
    """
    if low is None or high is None:
        df = materialize(df.select(value))
        limits = df.select(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
        start, stop = limits.getField("low").cast("double"), limits.getField("high").cast("double")
    else:
        start, stop = F.lit(float(low)), F.lit(float(high))
    ranged = df.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("_v"), start.alias("_start"), stop.alias("_stop")
    )
    width = F.col("_stop") - F.col("_start")
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_start")) * bins / width), F.lit(bins - 1))
    )
    inside = ranged.where(F.col("_v").between(F.col("_start"), F.col("_stop")))
    counted = inside.groupBy(place.cast("int").alias("bin"), "_start", "_stop").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda i: F.col("_start") + (F.col("_stop") - F.col("_start")) * i / bins
    return counted.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Box-plot numbers of a whole-number column per group: quartiles and whisker ends.

    Works on value counts, so a group of any size becomes one row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    found = F.percentile(value, F.array(*[F.lit(q) for q in QUARTILES]), F.col("_n"))
    boxes = counts.groupBy(by).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), found.alias("_q"))
    q1, q2, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    reach = (q3 - q1) * WHISKER
    fenced = boxes.select(by, "n", "min", "max", q1.alias("q25"), q2.alias("q50"), q3.alias("q75"),
                          (q1 - reach).alias("_low"), (q3 + reach).alias("_high"))
    inside = counts.join(fenced, by).where(F.col(value).between(F.col("_low"), F.col("_high")))
    ends = inside.groupBy(by).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return fenced.drop("_low", "_high").join(ends, by)


def term_counts(df: DataFrame, text: str, top: int = 100, stop_words: DataFrame | None = None) -> DataFrame:
    """(term, n, weight): the most frequent words; weight is relative to the first.

    ``stop_words`` is a DataFrame with a ``term`` column.
    """
    counted = df.select(F.explode(tx.tokens(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if stop_words is not None:
        counted = counted.join(stop_words.select("term"), "term", "left_anti")
    ranked = counted.orderBy(F.desc("n"), "term").limit(top)
    # At most ``top`` rows are left, so one task for their maximum is enough.
    return ranked.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def posts_per_day(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return df.where(F.col(timestamp).isNotNull()).groupBy(F.to_date(timestamp).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def temporal_summary(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One row: first and last time, days with posts, mean posts on such days."""
    days = df.where(F.col(timestamp).isNotNull()).groupBy(F.to_date(timestamp).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(timestamp).alias("first"), F.max(timestamp).alias("last")
    )
    return days.agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.count(F.lit(1)).alias("days"), F.avg("n").alias("posts_per_day"),
    )


def elapsed_days(first: Column, last: Column) -> Column:
    """Whole days between two times, not calendar days."""
    seconds = F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))
    return F.floor(seconds / SECONDS_PER_DAY).cast("long")


def date_span(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return df.agg(F.min(timestamp).alias("first"), F.max(timestamp).alias("last")).select(
        "first", "last", elapsed_days(F.col("first"), F.col("last")).alias("span_days")
    )


def day_extremes(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Mean and median posts per day, busiest and quietest day; the earliest on a tie."""
    busiest = F.min(F.struct((-F.col("n")).alias("less"), F.col("day")))
    quietest = F.min(F.struct("n", "day"))
    return (
        posts_per_day(df, timestamp)
        .agg(F.avg("n").alias("mean"), F.median("n").alias("median"), busiest.alias("_most"), quietest.alias("_least"))
        .select(
            "mean", "median",
            F.col("_most.day").alias("busiest_day"), (-F.col("_most.less")).alias("busiest_n"),
            F.col("_least.day").alias("quietest_day"), F.col("_least.n").alias("quietest_n"),
        )
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_and_length_by(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(text)).alias("avg_length"))


def share_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n, pct) of the non-null values, optionally the ``top`` most frequent.

    The total is a scalar subquery over all rows, nulls included.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        counted = counted.orderBy(F.desc("n"), column).limit(top)
    return counted.select(column, "n", percent("n", total).alias("pct"))


def length_outliers(df: DataFrame, value: str) -> DataFrame:
    """One row: fences at 1.5 interquartile ranges, outliers in number and percent."""
    quartiles = bounded_quantiles(df, value, (0.25, 0.75))
    reach = (F.col("q75") - F.col("q25")) * WHISKER
    fences = quartiles.select(F.struct((F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))).scalar()
    ranged = df.select(value, fences.getField("low").alias("_low"), fences.getField("high").alias("_high"))
    outside = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    return ranged.agg(
        F.max("_low").alias("low_fence"), F.max("_high").alias("high_fence"),
        count_where(outside).alias("outliers"), percent(count_where(outside), F.count(F.lit(1))).alias("outlier_pct"),
    )


def short_and_long(df: DataFrame, value: str) -> DataFrame:
    return df.agg(
        count_where(F.col(value) < SHORT_LENGTH).alias("very_short"),
        count_where(F.col(value) > LONG_LENGTH).alias("very_long"),
    )


def length_examples(df: DataFrame, text: str, key: str, short_rows: int = 3, long_rows: int = 2) -> DataFrame:
    """(kind, key, length, sample): the first short and long texts in key order."""
    size = F.length(text)
    pick = lambda kind, condition, rows: df.where(condition).orderBy(key).limit(rows).select(
        F.lit(kind).alias("kind"), key, size.alias("length"), F.substring(text, 1, 100).alias("sample")
    )
    return pick("short", size < SHORT_LENGTH, short_rows).unionByName(pick("long", size > LONG_LENGTH, long_rows))


def eda_summary(df: DataFrame, text: str, timestamp: str, platform: str) -> DataFrame:
    """One row: posts, mean length, distinct dates, platforms.

    Rows are first combined per date and platform, which is what the shuffle carries.
    """
    combined = df.groupBy(F.to_date(timestamp).alias("_day"), F.col(platform).alias("_platform")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length(text)).alias("_chars"), F.count(text).alias("_texts")
    )
    return combined.agg(
        F.sum("_n").alias("total_posts"),
        F.try_divide(F.sum("_chars"), F.sum("_texts")).alias("avg_text_length"),
        F.countDistinct("_day").alias("unique_dates"),
        F.countDistinct("_platform").alias("platforms"),
    )


def length_score_bins(df: DataFrame, length: str, score: str, length_width: int, score_width: int) -> DataFrame:
    """(length_bin, score_bin, n): the data of a scatter plot as counts."""
    cut = lambda column, width: F.floor(F.col(column) / width).cast("long")
    return df.groupBy(cut(length, length_width).alias("length_bin"), cut(score, score_width).alias("score_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def length_score_correlation(df: DataFrame, length: str, score: str) -> DataFrame:
    return df.agg(F.corr(length, score).alias("correlation"))


def example_rows(df: DataFrame, text: str, key: str, rows: int = 3, chars: int = 200, seed: int = DEFAULT_SEED) -> DataFrame:
    """A reproducible random handful of texts, cut to ``chars`` with an ellipsis."""
    return (
        df.orderBy(draw(key, seed), key).limit(rows)
        .select(key, F.length(text).alias("length"), tx.shorten(text, chars).alias("sample"))
    )


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, median, min, max) of numeric columns with any value domain.

    One pass profiles all columns and one finds all medians, however many columns there are.
    """
    found = materialize(profile(df, columns))
    exact = exact_quantiles(df, found, [0.5])
    return found.join(exact, "column_name").select("column_name", "mean", F.col("q50").alias("median"), F.col("low").alias("min"), F.col("high").alias("max"))
