"""Streams of landed post files: ingest, drop repeats, count per hour, clean and score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxgrain.operators.cleaning import process_posts


def ingest(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
    pattern: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """New post files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def event_time(posts: DataFrame, timestamp: str, delay: str) -> DataFrame:
    """Zoned event time with a watermark, which bounds the state of what is appended downstream.

    A complete result keeps all its groups whatever the watermark.
    """
    return posts.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, delay)


def drop_repeats(posts: DataFrame, key: str) -> DataFrame:
    """One row per key among rows that arrive within the watermark of each other."""
    return posts.dropDuplicatesWithinWatermark([key])


def drop_repeats_ever(posts: DataFrame, key: str, earlier: DataFrame | None = None) -> DataFrame:
    """One row per key among all rows of the stream, however far apart, over restarts from its checkpoint.

    The state holds every key seen, so it belongs in a state store on disk (RocksDB, which
    ``get_session`` sets), where only its size on disk grows. Keys of ``earlier`` output, of another
    stream or a batch run, are dropped too; they are joined and not kept in the state. Rows
    without a key are one row.
    """
    fresh = posts.join(earlier.select(key).distinct(), key, "left_anti") if earlier is not None else posts
    return fresh.dropDuplicates([key])


def hourly_counts(posts: DataFrame, timestamp: str, sentiment: str) -> DataFrame:
    """(hour, sentiment, n) in tumbling windows of one hour."""
    windows = posts.groupBy(F.window(timestamp, "1 hour").alias("_window"), sentiment)
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("_window.start").alias("hour"), sentiment, "n")


def clean_and_score(posts: DataFrame, label: Callable[[DataFrame], DataFrame] | Column, **options) -> DataFrame:
    """Clean, keep valid rows, and add ``predicted_sentiment``, row by row.

    ``label`` is a Column or a function such as a fitted model's transform.
    """
    kept = process_posts(posts, **options)
    return kept.withColumn("predicted_sentiment", label) if isinstance(label, Column) else label(kept)


def append_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished rows as parquet, exactly once, until the input at hand is used up."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def replace_result(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the complete result of each batch to its own folder ``batch=<id>``.

    A repeated batch overwrites its folder, so a restart cannot double the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_result(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest batch folder."""
    batches = spark.read.parquet(path)
    newest = batches.select(F.max("batch")).scalar()
    return batches.where(F.col("batch") == newest).drop("batch")
