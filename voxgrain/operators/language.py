"""Language identification by character trigrams (Cavnar & Trenkle 1994, naive Bayes).

A profile is learned by counting; texts are scored by looking their trigrams up in it and adding
up log-probabilities. Trigrams are numbers made of three code points and never become rows: a task
counts or looks up those of many texts at a time, and only counts per distinct trigram are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.functions import text as tx
from voxgrain.functions.sampling import DEFAULT_SEED, draw
from voxgrain.functions.stats import percent

UNKNOWN = "unknown"
OTHERS = "outros"
PROFILE_GRAMS = 5000
MAX_PROFILE_GRAMS = 100_000
MAX_LANGUAGES = 1000
SCORE_DIGITS = 6
SLICE_BYTES = 512 << 10


def _framed(text: Column | str) -> Column:
    """The cleaned text between two spaces."""
    return F.concat(F.lit(" "), tx.clean_text(text), F.lit(" "))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at a time that their trigrams take little memory."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def trigram_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all overlapping trigrams of the texts, as numbers; 21 bits per code point."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) > 2 else points[:0]
    rows = np.repeat(np.arange(len(texts)), sizes)[:len(codes)]
    whole = np.arange(len(codes)) + 3 <= ends[rows]
    return rows[whole], codes[whole]


def _as_code(gram: str) -> int:
    first, second, third = map(ord, gram)
    return first << 42 | second << 21 | third


def _as_gram(code: int) -> str:
    return "".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def trigram_counts(df: DataFrame, text: str, label: str, languages: Sequence[str]) -> DataFrame:
    """(gram, n_0, n_1, ..., n): how often each trigram occurs in the texts of each language and in all."""
    place = {name: i for i, name in enumerate(languages)}
    names = [f"n_{i}" for i in range(len(languages))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, codes = trigram_codes([t or "" for t in batch.column(1).to_pylist()])
            known, at = np.unique(codes, return_inverse=True)
            labels = np.array([place[name] for name in batch.column(0).to_pylist()], np.int64)
            counts = np.bincount(at * len(place) + labels[rows], minlength=len(known) * len(place)).reshape(len(known), len(place))
            grams = pa.array([_as_gram(code) for code in known.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([grams, *[pa.array(counts[:, i]) for i in range(len(place))]], names=["gram", *names])

    texts = df.where(F.col(label).isin(list(languages))).select(F.col(label).cast("string").alias("label"), _framed(text).alias("text"))
    counted = texts.mapInArrow(count, ", ".join(["gram string", *[f"{n} long" for n in names]]))
    summed = counted.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])
    return summed.withColumn("n", sum((F.col(n) for n in names), F.lit(0).cast("long")))


def language_list(df: DataFrame, label: str) -> list[str]:
    """The labels in use, sorted: one short driver list, as for a pivot.

    More labels than MAX_LANGUAGES are refused rather than cut.
    """
    found = df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [row[0] for row in found]


def language_profile(
    df: DataFrame, text: str, label: str, languages: Sequence[str], grams: int = PROFILE_GRAMS
) -> DataFrame:
    """(gram, score_0, score_1, ...): add-one log-probabilities, one column per language.

    The ``grams`` most frequent trigrams are kept, ties in trigram order. Training texts
    are counted whole, and map-side combining leaves one row per trigram, language and task.
    """
    if grams > MAX_PROFILE_GRAMS:
        raise ValueError(f"at most {MAX_PROFILE_GRAMS} trigrams, so that the profile can be broadcast")
    counted = trigram_counts(df, text, label, languages)
    kept = counted.orderBy(F.desc("n"), "gram").limit(grams)
    sums = F.struct(
        F.count(F.lit(1)).alias("size"), *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(languages))]
    )
    totals = kept.select(sums.alias("totals")).scalar()
    scores = [
        F.log((F.col(f"n_{i}") + 1.0) / (totals.getField(f"n_{i}") + totals.getField("size"))).alias(f"score_{i}")
        for i in range(len(languages))
    ]
    return kept.select("gram", *scores)


def detect_language(
    df: DataFrame, text: str, key: str, profile: DataFrame, languages: Sequence[str], output: str = "detected_lang"
) -> DataFrame:
    """(key, detected language): the best-scoring language of every row, ties in the given order.

    The profile has a bounded number of rows and goes to every task; no row is shuffled. Texts
    without a known trigram are ``unknown``.
    """
    names = [f"score_{i}" for i in range(len(languages))]
    table = sorted((_as_code(r["gram"]), *[r[n] for n in names]) for r in profile.collect())
    known = np.array([r[0] for r in table], np.int64)
    scores = np.array([r[1:] for r in table], np.float64).reshape(len(table), len(names))
    schema = T.StructType([df.schema[key], T.StructField(output, T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, codes = trigram_codes([t or "" for t in batch.column(1).to_pylist()])
            place = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            hit = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            rows, place = rows[hit], place[hit]
            sums = np.stack([np.bincount(rows, scores[place, i], batch.num_rows) for i in range(len(names))], axis=1).round(SCORE_DIGITS)
            found = np.bincount(rows, minlength=batch.num_rows) > 0
            best = [languages[i] if ok else UNKNOWN for i, ok in zip(sums.argmax(axis=1).tolist(), found.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], names=schema.names)

    return df.select(key, _framed(text).alias("_text")).mapInArrow(score, schema)


def language_sample(df: DataFrame, key: str, size: int = 1000, seed: int = DEFAULT_SEED) -> DataFrame:
    """A reproducible sample of at most ``size`` rows."""
    return df.withColumn("_draw", draw(key, seed)).orderBy("_draw", key).limit(size).drop("_draw")


def language_mix(detected: DataFrame, column: str = "detected_lang", top: int = 6) -> DataFrame:
    """(language, n, pct): the ``top`` languages and the rest folded into one row.

    The counts per language are a handful of rows, so ranking them in one task is cheap.
    """
    counts = detected.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    ranked = counts.withColumn(
        "_place", F.row_number().over(everything.orderBy(F.desc("n"), column))
    ).withColumn("_all", F.sum("n").over(everything))
    folded = F.when(F.col("_place") <= top, F.col(column)).otherwise(F.lit(OTHERS))
    return (
        ranked.groupBy(folded.alias("language"))
        .agg(F.sum("n").alias("n"), F.max("_all").alias("_all"))
        .select("language", "n", percent("n", "_all").alias("pct"))
    )


def language_share(detected: DataFrame, target: str, column: str = "detected_lang") -> DataFrame:
    """One row: share of the target language in percent and number of languages."""
    return detected.agg(
        percent(F.count(F.when(F.col(column) == target, 1)), F.count(F.lit(1))).alias("target_pct"),
        F.countDistinct(column).alias("languages"),
    )
