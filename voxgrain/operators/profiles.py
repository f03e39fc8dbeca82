"""Profiles of numeric columns that can be stored per run and merged, and exact quantiles from them.

One pass over the rows makes a row per group and column: counts, moments, bounds, a sketch of ranks and
one of distinct values. Profiles of further rows are merged with it without reading rows again.

A quantile is exact after refining: the sketch gives two values that it surely lies between, or nearly
so, and one pass counts, for all columns and quantiles together, the rows below and between, which
proves it. While too many lie between, a sketch of those alone narrows the bounds, to about a
twentieth a pass. The values that are left are then counted and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from voxgrain.operators.ranking import quantile_name
from voxgrain.sources.files import materialize

FEW = 1_000_000
"""Rows between the bounds that are counted value by value."""

MARGIN = 0.025
"""Ranks on either side of the wanted one that the sketch may be wrong by; about twice its usual error."""


def _measures(column: Column) -> list[Column]:
    value = column.cast("double")
    return [
        F.count(value).alias("n"), F.count_if(value.isNull()).alias("nulls"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.kll_sketch_agg_double(value).alias("ranks"), F.hll_sketch_agg(value.cast("string")).alias("distinct"),
    ]


def profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, n, nulls, mean, squares, low, high, ranks, distinct): one row per group and column, from one pass.

    ``squares`` is the sum of squared distances from the mean.
    """
    wide = df.groupBy(*by).agg(*[F.struct(F.lit(c).alias("column_name"), *_measures(F.col(c))).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def merged(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of several runs (rows of equal ``by`` and column_name) as one."""
    keys = [*by, "column_name"]
    whole = W.Window.partitionBy(*keys)
    mean = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    return profiles.withColumn("_mean", mean).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.max("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("distinct").alias("distinct"),
    )


def figures(profiles: DataFrame, probabilities: Sequence[float] = ()) -> DataFrame:
    """A profile's readable figures: mean, sample deviation, bounds, about how many distinct values, and about the quantiles."""
    about = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))).alias(f"about_{quantile_name(p)}") for p in probabilities]
    other = [c for c in profiles.columns if c not in ("squares", "ranks", "distinct", "low", "high", "mean")]
    return profiles.select(
        *other, "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"), "low", "high",
        F.hll_sketch_estimate("distinct").alias("about_distinct"), *about,
    )


@dataclass
class _Search:
    """Where a quantile of a column is looked for: the places of its one or two values, and bounds that hold them."""

    column: str
    probability: float
    n: int
    low: float
    high: float
    below: int = 0
    between: int = 0
    margin: float = 0.0

    @property
    def places(self) -> tuple[int, int]:
        at = self.probability * (self.n - 1)
        return math.floor(at), math.ceil(at)


def _narrowed(df: DataFrame, searches: list[_Search]) -> list[tuple[int, int, float | None, float | None]]:
    """(rows below, rows between, next low, next high) per search, from one pass over the rows."""
    parts = []
    for i, s in enumerate(searches):
        value = F.col(s.column).cast("double")
        inside = (value >= s.low) & (value <= s.high)
        parts += [F.count_if(value < s.low).alias(f"below{i}"), F.count_if(inside).alias(f"between{i}"), F.kll_sketch_agg_double(F.when(inside, value)).alias(f"ranks{i}")]
    counted = materialize(df.agg(*parts))
    row = counted.select(*[f"{c}{i}" for i in range(len(searches)) for c in ("below", "between")]).first()
    # Ranks asked of a sketch must be constants, so its one row is kept and asked afterwards.
    bounds = []
    for i, s in enumerate(searches):
        for place, sign in zip(s.places, (-1, 1)):
            rank = min(1.0, max(0.0, (place - row[f"below{i}"]) / max(1, row[f"between{i}"] - 1) + sign * s.margin))
            value = F.kll_sketch_get_quantile_double(f"ranks{i}", F.lit(rank)) if row[f"between{i}"] else F.lit(None).cast("double")
            bounds.append(value.alias(f"bound{len(bounds)}"))
    found = counted.select(*bounds).first()
    return [(row[f"below{i}"], row[f"between{i}"], found[2 * i], found[2 * i + 1]) for i in range(len(searches))]


def exact_quantiles(df: DataFrame, found: DataFrame, probabilities: Sequence[float], few: int = FEW) -> DataFrame:
    """(column_name, q<percent> ...): linearly interpolated quantiles of the columns of an ungrouped profile of ``df``.

    Columns without values have nulls. Not-a-number counts as larger than any number.
    """
    spark = df.sparkSession
    ranks = [F.when(F.col("n") > few, F.kll_sketch_get_quantile_double("ranks", F.lit(r))) for p in probabilities for r in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    heads = found.select("column_name", "n", "low", "high", *[r.alias(f"r{i}") for i, r in enumerate(ranks)]).collect()
    searches = []
    for h in heads:
        for i, p in enumerate(probabilities):
            if h["n"]:
                low, high = (h["low"], h["high"]) if h["n"] <= few else (h[f"r{2 * i}"], h[f"r{2 * i + 1}"])
                searches.append(_Search(h["column_name"], float(p), h["n"], low, high, 0, h["n"], MARGIN))
    limits = {h["column_name"]: (h["low"], h["high"]) for h in heads}
    unsure = [s for s in searches if s.n > few]
    while unsure:
        rest = []
        for s, (below, between, low, high) in zip(unsure, _narrowed(df, unsure)):
            s.below, s.between = below, between
            first, last = s.places
            if first < below or last >= below + between:
                # The sketch was further off than the margin on this side; the next may be, too.
                s.margin = 2 * abs(s.margin) + 0.01
                s.low = limits[s.column][0] if first < below else s.low
                s.high = limits[s.column][1] if last >= below + between else s.high
                rest.append(s)
            elif between > few and (low, high) != (s.low, s.high):
                s.low, s.high = low, high
                rest.append(s)
        unsure = rest
    if not searches:
        return spark.createDataFrame([(h["column_name"], *[None] * len(probabilities)) for h in heads], ", ".join(["column_name string", *[f"{quantile_name(p)} double" for p in probabilities]]))
    cells = F.array(*[
        F.when((F.col(s.column).cast("double") >= s.low) & (F.col(s.column).cast("double") <= s.high), F.struct(F.lit(i).alias("search"), F.col(s.column).cast("double").alias("value")))
        for i, s in enumerate(searches)
    ])
    values = df.select(F.inline(F.filter(cells, lambda c: c.isNotNull()))).groupBy("search", "value").agg(F.count(F.lit(1)).alias("n"))
    through = W.Window.partitionBy("search").orderBy("value")
    at = spark.createDataFrame([(i, s.below, *s.places, s.column, s.probability, s.probability * (s.n - 1) - s.places[0]) for i, s in enumerate(searches)],
                               "search int, below long, first long, last long, column_name string, probability double, share double")
    placed = values.withColumn("end", F.sum("n").over(through)).join(F.broadcast(at), "search").withColumn("end", F.col("end") + F.col("below"))
    begin = F.col("end") - F.col("n")
    pick = lambda place: F.max(F.when((begin <= F.col(place)) & (F.col(place) < F.col("end")), F.col("value")))
    each = placed.groupBy("column_name", "probability", "share").agg(pick("first").alias("a"), pick("last").alias("b"))
    value = F.col("a") + F.when(F.col("share") > 0, F.col("share") * (F.col("b") - F.col("a"))).otherwise(0.0)
    wide = each.groupBy("column_name").agg(*[F.max(F.when(F.col("probability") == float(p), value)).alias(quantile_name(p)) for p in probabilities])
    return found.select("column_name").join(wide, "column_name", "left")
