"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass reads the texts and keeps some twenty statistics per document. Labelled documents among
them are standardised and mapped to cosines of random projections, whose inner products approximate
a Gaussian kernel. Tasks sum the normal equations of their rows; the sums are added and solved on
the driver, where they have a fixed size. The scores of labelled documents that were kept out of the
fit are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import byte_values, small, stored

FEATURES = 256
GAMMA = 0.05
RIDGE = 1e-2
LABELLED = 200_000
"""At most about so many labelled rows are used for fitting and calibration together."""

SUMMING_TASKS = 32
CLASSES = {
    "letters": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), "capitals": bytes(range(65, 91)),
    "digits": b"0123456789", "stops": b".,;:?", "shouts": b"!", "bars": b"|", "signs": b"#$%&*@\\^_~<>{}[]=+/", "quotes": b"\"'()`-",
}
STATISTICS = [
    *CLASSES, "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "distinct_words", "log_lines",
    "words_per_line", "distinct_lines", "capital_words", "marked_words", "top_byte",
]


def statistics(data: bytes) -> list[float]:
    """The document statistics of UTF-8 bytes; an empty text has all zero."""
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    dense = max(1, len(data) - int(counts[32] + counts[9:14].sum()))
    shares = [float(counts[list(members)].sum()) / dense for members in CLASSES.values()]
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    m = max(1, len(lines))
    return [
        *shares, np.log1p(len(data)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        float((lengths > 14).sum()) / n, len(set(words)) / n, np.log1p(len(lines)), np.log1p(len(words) / m), len(set(lines)) / m,
        sum(w.isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        float(counts[33:].max()) / dense,
    ]


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats): the statistics of every row's whole text; null texts are empty."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [statistics(t) for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "stats"])

    return docs.select(key, text).mapInArrow(measure, schema)


@dataclass
class Model:
    """Everything a score needs: scaling, projection, ridge weights, calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.values) if len(self.steps) else np.full(len(stats), 0.5)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, values): the increasing function nearest to y, by pooling adjacent violators.

    Equal x are pooled first. A step is a pool's mean x; values are drawn towards the mean of all
    by half a row each way, so that none is 0 or 1.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    pools: list[list[float]] = []  # rows, sum of y, sum of x
    for n, sy, sx in zip(np.diff(np.r_[starts, len(x)]), np.add.reduceat(y, starts), np.add.reduceat(x, starts)):
        pools.append([float(n), float(sy), float(sx)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, sy, sx = np.array(pools).T
    return sx / n, (sy + 0.5 * y.mean()) / (n + 0.5)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", seed: int = 7) -> Model:
    """Fit on the rows of ``stats`` that have a label of 0 or 1.

    At most about LABELLED rows are used, drawn by a hash of the key; every fourth of them, by
    another hash, calibrates and the others fit; if one of the two parts lacks a label, all rows do
    both. A key with several labels counts as several rows. Without both labels there are no
    calibration steps and every score is one half.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y"))
    share = min(1.0, LABELLED / max(1, known.count()))
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64("_key", F.lit(salt)), 11) / float(1 << 53)
    known = known.where(draw(seed) < share).withColumn("fold", F.floor(draw(seed + 1) * 4))
    rows = stored(
        stats.join(known, stats[key] == known["_key"]).select("_key", "stats", "y", "fold").repartition(SUMMING_TASKS, "_key"), "labelled"
    )
    width = len(STATISTICS)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"),
        F.count_if(F.col("fold") == 0).alias("held"), F.sum(F.when(F.col("fold") == 0, F.col("y")).otherwise(0.0)).alias("held_ones"),
        *[f(F.get("stats", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(width)],
    ).first()
    generator = np.random.default_rng(seed)
    empty = Model(
        np.zeros(width), np.ones(width), generator.normal(size=(width, FEATURES)) * np.sqrt(2 * GAMMA),
        generator.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0),
    )
    if not moments["n"] or moments["ones"] in (0, moments["n"]):
        return empty
    both = 0 < moments["held_ones"] < moments["held"] and 0 < moments["ones"] - moments["held_ones"] < moments["n"] - moments["held"]
    fitting, calibrating = (F.col("fold") > 0, F.col("fold") == 0) if both else (F.lit(True), F.lit(True))
    empty.mean = np.array([moments[f"avg{i}"] for i in range(width)])
    empty.scale = np.maximum([moments[f"stddev_pop{i}"] for i in range(width)], 1e-3)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                x = empty.features(np.array(batch.column(0).to_pylist()))
                total += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.where(fitting).select("stats", "y").coalesce(SUMMING_TASKS).mapInArrow(sums, "sums binary").toLocalIterator()
    total = sum(np.frombuffer(row["sums"]).reshape(FEATURES + 1, FEATURES + 2) for row in parts)
    penalty = RIDGE * moments["n"] / FEATURES * np.diag(np.r_[np.ones(FEATURES), 0])
    empty.weights = np.linalg.lstsq(total[:, :-1] + penalty, total[:, -1], rcond=None)[0]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = empty.raw(np.array(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], names=["raw", "y"])

    held = rows.where(calibrating).select("stats", "y").mapInArrow(scores, "raw double, y double").toArrow()
    empty.steps, empty.values = isotonic(held.column("raw").to_numpy(), held.column("y").to_numpy())
    return empty


def score(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of a statistics table."""
    schema = T.StructType([stats.schema[key], T.StructField("score", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], names=[key, "score"])

    return stats.select(key, "stats").mapInArrow(rate, schema)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, score, predicted) per row of ``docs``: the calibrated chance that the label is 1.

    ``labels`` are the rows to learn from. Null and empty texts are scored like any other, by
    statistics of zero; keys may be null or repeated. Only key and text are read. Texts of any
    length are held by one task at a time. An empty table gives no rows; with no usable labels
    every score is one half.
    """
    stats = stored(statistics_table(docs, key, text), "statistics")
    scored = score(stats, fit(stats, labels, key, label), key)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not rejected, scored in the same pass that reads them.

    Statistics are gathered once to fit; the filter then scores each row in place, so that no text
    is shuffled. Null and empty texts are judged like any other. Where the labels of these documents
    are missing or all alike nothing can be judged, and all rows stay.
    """
    model = fit(stored(statistics_table(docs, key, text), "statistics"), labels, key)
    if not len(model.steps):
        return docs
    place = docs.columns.index(text)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            stats = np.array([statistics(t) for t in byte_values(batch.column(place))])
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(passing, docs.schema)
