"""Reading, combining, writing and checking post files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.functions.text import slug
from voxgrain.sources import csv_split

CHECKPOINT_SETTING = "spark.checkpoint.dir"
CORRUPT = "_corrupt"

# Texts hold line breaks, quotes and blanks at either end, which must survive.
CSV_READ = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder the cluster names in spark.checkpoint.dir.

    Without that setting it lies below the session's warehouse, which executors share too.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/voxgrain-{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small result once and cut its lineage, in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def read_posts(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: T.StructType | None = None,
    pattern: str | None = None, recursive: bool = False, with_source: bool = False, multi_line: bool = True,
) -> DataFrame:
    """Read csv, json (one object per line) or parquet files.

    ``pattern`` is a glob on file names. Texts of CSV files may hold line breaks; large files are
    read by many tasks nevertheless (``csv_split``), after a pass that counts quotes.
    ``multi_line`` off takes each line for a row. Without a schema, CSV files are read by their
    own headers and united by name; a column missing from a file is null there. ``with_source``
    adds the file's stem as ``file_source``.
    """
    if fmt == "csv" and schema is None:
        groups = _by_header(spark, path, pattern, recursive)
        if len(groups) > 1 or (groups and multi_line):
            parts = [read_posts(spark, paths, fmt, T.StructType([T.StructField(c, T.StringType()) for c in header]), None, False, with_source, multi_line) for header, paths in groups.items()]
            return combine(parts)
    if fmt == "csv" and multi_line:
        return csv_split.read_csv(spark, path, schema, CSV_READ, pattern, recursive, "file_source" if with_source else None)
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**{**CSV_READ, "multiLine": multi_line})
    df = reader.format(fmt).load(path)
    if with_source:
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        df = df.select("*", stem.alias("file_source"))
    return df


def _by_header(spark: SparkSession, path: str | Sequence[str], pattern: str | None, recursive: bool) -> dict[tuple[str, ...], list[str]]:
    """Paths of the CSV files by the columns their first line names, in order of path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in reader.load(path).select("path").orderBy("path").collect():
        header = tuple(spark.read.options(**CSV_READ).csv(row["path"]).columns)
        groups.setdefault(header, []).append(row["path"])
    return groups


def read_each(
    spark: SparkSession, folder: str, fmt: str, required: Sequence[str], pattern: str | None = None
) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Every file of a folder for itself, by its stem: those with the required columns, and what the others lack.

    A file that cannot be read counts as lacking everything.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    sources, broken = {}, {}
    for row in reader.load(folder).select("path").orderBy("path").collect():
        stem = row["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            sources[stem] = read_posts(spark, row["path"], fmt, with_source=True)
        except AnalysisException:
            broken[stem] = list(required)
    good, lacking = usable(sources, required)
    return good, lacking | broken


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over the cores by key if the scan has fewer splits than cores.

    A no-op on any input of real size, whose files give more splits than that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a part is null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def usable(sources: Mapping[str, DataFrame], required: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Split sources by schema: those with all required columns, and what the others lack."""
    lacking = {name: [c for c in required if c not in df.columns] for name, df in sources.items()}
    good = {name: df for name, df in sources.items() if not lacking[name]}
    return good, {name: columns for name, columns in lacking.items() if columns}


def split_corrupt(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of a text column that holds one JSON object per row."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(F.from_json(column, full, options).alias("_row"))
    good = parsed.where(F.col(f"_row.{CORRUPT}").isNull()).select("_row.*").drop(CORRUPT)
    bad = parsed.where(F.col(f"_row.{CORRUPT}").isNotNull()).select(F.col(f"_row.{CORRUPT}").alias("line"))
    return good, bad


def write_posts(
    df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists"
) -> str:
    """Write parquet (snappy), csv or json, optionally one folder per value of ``by``."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    elif fmt == "csv":
        writer.options(**CSV_WRITE).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def run_path(folder: str, stem: str, run_id: str) -> str:
    return f"{folder.rstrip('/')}/{stem}_{run_id}"


def topic_slug(df: DataFrame, topic: str) -> DataFrame:
    return df.withColumn("topic_slug", slug(topic))


def run_metadata(
    spark: SparkSession, statistics: DataFrame, settings: Mapping[str, str], run_at: str, kind: str
) -> DataFrame:
    """One row to be written as JSON: time, kind, settings and a one-row statistics table."""
    values = [F.lit(value).cast("string").alias(name) for name, value in settings.items()]
    return statistics.select(
        F.lit(run_at).alias("timestamp"), F.lit(kind).alias("model_type"),
        F.struct(*[F.col(c) for c in statistics.columns]).alias("metrics"),
        F.struct(*values).alias("model_info"),
    )


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(file, accuracy, f1_macro) of every metrics file below the folder."""
    schema = "timestamp string, model_type string, metrics struct<accuracy double, f1_macro double>"
    found = spark.read.option("recursiveFileLookup", True).schema(schema).json(folder)
    return found.where(F.col("metrics").isNotNull()).select(
        F.col("_metadata.file_name").alias("file"), "model_type", "metrics.accuracy", "metrics.f1_macro"
    )


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, folder, file_name, bytes, modified) of the files below a folder; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """(folder, extension, files, bytes)."""
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    return files.groupBy("folder", extension.alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def newest_dataset(spark: SparkSession, folder: str, pattern: str) -> str:
    """The most recently modified file, the last path on a tie; of a Spark-written one, its folder."""
    newest = list_files(spark, folder, pattern).orderBy(F.desc("modified"), F.desc("path")).limit(1)
    found = newest.select("folder", "path", "file_name").first()
    if found is None:
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return found["folder"] if found["file_name"].startswith("part-") else found["path"]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum."""
    # A hash passes over nulls, so every column also says whether it is one.
    parts = [part for c in sorted(df.columns) for part in (F.col(c).isNull(), F.col(c))]
    digest = F.xxhash64(*parts).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def compare_written(expected: DataFrame, written: DataFrame) -> DataFrame:
    """One row: rows on both sides, and whether counts and checksums agree."""
    other = fingerprint(written.select(*expected.columns)).select(F.struct("rows", "checksum")).scalar()
    return fingerprint(expected).select(
        F.col("rows").alias("rows_expected"),
        other.getField("rows").alias("rows_written"),
        (F.col("rows") == other.getField("rows")).alias("same_count"),
        (F.col("checksum") == other.getField("checksum")).alias("same_content"),
    )
