"""What several operators share: stored intermediates, prefix bases, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from voxgrain.sources.files import scratch_folder

WHITE = "\\x20\\x09-\\x0D"
"""The six white-space characters that separate words, inside a regular expression's brackets."""

ZSTD = {"compression": "zstd"}

FEW_EDGES = 1 << 16
"""So many edges are joined by one task, in a few megabytes."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared place; it goes when the application ends."""
    path = scratch_folder(spark, purpose)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: lost executors cost no second computation."""
    path = scratch(df.sparkSession, purpose)
    df.write.options(**ZSTD).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_values(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null as empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def text_values(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null as empty."""
    return [value or "" for value in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that long texts do not pile up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_base(df: DataFrame, part: str, ids: str, base: str) -> DataFrame:
    """Add the sum of ``ids`` over all smaller values of ``part``.

    ``part`` numbers the tasks that wrote the table, so the totals are one small row per writing
    task; that is the bound of the broadcast and of the one-task window.
    """
    totals = df.groupBy(part).agg(F.sum(ids).alias("_sum"))
    before = W.Window.orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(base))
    return df.join(F.broadcast(bases), part)


def _kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, to): each node of these few edges with the smallest node of its component."""
    sides = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if sides:
        node, smallest = forest(*(np.concatenate(side) for side in zip(*sides)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(smallest)], names=["at", "to"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Every round each node joins the neighbour (or itself) with the smallest draw of the round and
    the edges are rewritten between the joined nodes, so paths and stars of any size shrink by a
    constant share a round. Only aggregates and joins are used: a node with many neighbours is
    combined map-side or split by adaptive execution. Once no more than FEW_EDGES are left, one task
    joins them. Nodes are whole numbers. Null nodes are ignored; no edges give no rows.
    """
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    nodes = _kept(
        ends.select("u").union(ends.select("v")).where(F.col("u").isNotNull()).distinct()
        .select(F.col("u").alias("node"), F.col("u").alias("label"))
    )
    pairs = _kept(ends.where(F.col("u") != F.col("v")).distinct())
    salt = 0
    while left := pairs.limit(FEW_EDGES + 1).count():
        if left <= FEW_EDGES:
            joined = pairs.coalesce(1).mapInArrow(_at_once, T.StructType([T.StructField(c, pairs.schema["u"].dataType) for c in ("at", "to")]))
            nodes = nodes.join(joined, nodes["label"] == joined["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
            break
        salt += 1
        draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("draw"), F.col(c).alias("to"))  # noqa: E731, B023
        both = pairs.union(pairs.select("v", "u"))
        nearest = both.groupBy("u").agg(F.min(draw("v")).alias("near"))
        joined = _kept(nearest.select(F.col("u").alias("at"), F.least(draw("u"), F.col("near")).getField("to").alias("to")))
        pairs = _kept(
            pairs.join(joined, pairs["u"] == joined["at"]).select(F.col("to").alias("x"), "v")
            .join(joined, F.col("v") == F.col("at")).select(F.col("x").alias("u"), F.col("to").alias("v"))
            .where(F.col("u") != F.col("v")).distinct()
        )
        nodes = _kept(
            nodes.join(joined, nodes["label"] == joined["at"], "left")
            .select("node", F.coalesce("to", "label").alias("label"))
        )
    smallest = nodes.groupBy("label").agg(F.min("node").alias("component"))
    return nodes.join(smallest, "label").select("node", "component")
