"""Exact ranks and quantiles that never put one large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgrain.sources.files import materialize

# Spark cuts each group before the shuffle for literal limits below this value
# (spark.sql.optimizer.windowGroupLimitThreshold, 1000 unless it is set otherwise).
GROUP_LIMIT_THRESHOLD = 1000
DEFAULT_SPREAD = 64
SLOT_BITS = 10
DRAW_BITS = 32
QUANTILE_SPLITS = 256
FEW_VALUES = 1_000_000


def keep_top(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    limit: int | Column,
    key: str,
    bound: int | None = None,
    rank: str = "rank",
    spread: int = DEFAULT_SPREAD,
) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, numbered from 1 in ``rank``.

    ``order`` must be total. ``bound`` is a known upper bound of a Column limit. Below
    the threshold the bound is put into the filter as a literal, so that each task sends
    at most ``bound`` rows per group to the shuffle. Otherwise each group is first cut in
    ``spread`` slices, which bounds what the last window sees to limit * spread rows.
    """
    by = list(by)
    bound = limit if isinstance(limit, int) else bound
    last = Window.partitionBy(*by).orderBy(*order)
    if bound is None or bound >= GROUP_LIMIT_THRESHOLD:
        slices = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(spread)))
            .withColumn("_in_slice", F.row_number().over(slices))
            .where(F.col("_in_slice") <= limit)
            .drop("_slice", "_in_slice")
        )
        return df.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= limit)
    ranked = df.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= bound)
    return ranked if isinstance(limit, int) else ranked.where(F.col(rank) <= limit)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order; null keys form one group."""
    first = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(first)).where(F.col("_place") == 1).drop("_place")


def number_within(
    df: DataFrame, by: Sequence[str], draw: str, key: str, name: str = "number", total: str | None = None
) -> DataFrame:
    """Number the rows of each group from 1 by (draw, key), for groups of any size.

    ``draw`` is evenly spread over [0, 2^32). Its top bits cut every group into slots of
    about equal size. Slot counts, a table of groups x slots, give each slot its offset,
    and rows are numbered inside their slot. ``total`` adds the size of the group.
    """
    by = list(by)
    slotted = df.withColumn("_slot", F.shiftright(F.col(draw), DRAW_BITS - SLOT_BITS).cast("int"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        slotted.groupBy(*by, "_slot")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *[F.col(name).alias(f"_by{i}") for i, name in enumerate(by)],
            F.col("_slot").alias("_in"),
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_size").over(group).alias("_total"),
        )
    )
    same = F.col("_slot") == F.col("_in")
    for i, column in enumerate(by):
        same = same & F.col(column).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_slot").orderBy(draw, key)
    numbered = slotted.withColumn("_inside", F.row_number().over(inside)).join(slots, same)
    added = [(F.col("_before") + F.col("_inside")).alias(name)]
    if total:
        added.append(F.col("_total").alias(total))
    return numbered.select(*df.columns, *added)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: the shuffle carries one row per value and task."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one ``q<percent>`` column each, for any value domain.

    Distinct values are counted once and written.
    """
    return counted_quantiles(materialize(value_counts(df, value, by)), value, probabilities, by)


def counted_quantiles(counts: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same from distinct values and their counts (by, value, n), written before.

    If they are few, which is checked, the exact percentile runs over the counts; beyond
    that they are ranked in slots.
    """
    if counts.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return _percentiles(counts, value, probabilities, by)
    return quantiles_in_slots(counts, value, probabilities, by)


def quantiles_in_slots(counts: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of counted values (by, value, n) of which there are too many for one task.

    Values are cut into slots at approximate quantiles, and only the slots that hold a
    wanted position are ranked, so no task sees more than its slots.
    """
    by = list(by)
    # The group is one struct, which is never null, so null values are a group like any other
    # and no groups at all are one.
    groups = ["_group"]
    counts = counts.withColumn("_group", F.struct(F.lit(1).alias("_all"), *[F.col(c) for c in by]))
    marks = [(i + 1) / QUANTILE_SPLITS for i in range(QUANTILE_SPLITS - 1)]
    splits = counts.groupBy(*groups).agg(
        F.percentile_approx(value, F.array(*[F.lit(m) for m in marks]), F.lit(10 * QUANTILE_SPLITS)).alias("_splits"),
        F.sum("n").alias("_rows"),
    )
    slotted = counts.join(splits, groups).withColumn(
        "_slot", F.size(F.filter("_splits", lambda split: split < F.col(value)))
    ).drop("_splits")
    through = Window.partitionBy(*groups).orderBy("_slot")
    slots = (
        slotted.groupBy(*groups, "_slot", "_rows")
        .agg(F.sum("n").alias("_size"))
        .withColumn("_end", F.sum("_size").over(through))
    )
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(side).alias("side")) for p in probabilities for side in (0, 1)])
    positions = slots.select(*groups, "_slot", "_rows", "_size", "_end", F.explode(wanted).alias("_want"))
    place = F.col("_want.p") * (F.col("_rows") - 1)
    positions = positions.withColumn(
        "_at", F.when(F.col("_want.side") == 0, F.floor(place)).otherwise(F.ceil(place))
    ).where((F.col("_end") > F.col("_at")) & (F.col("_end") - F.col("_size") <= F.col("_at")))
    held = positions.select(*groups, "_slot", (F.col("_end") - F.col("_size")).alias("_before"), "_want", "_at")
    inside = Window.partitionBy(*groups, "_slot").orderBy(value)
    ranked = (
        slotted.join(held.select(*groups, "_slot", "_before").distinct(), [*groups, "_slot"])
        .withColumn("_through", F.col("_before") + F.sum("n").over(inside))
        .withColumn("_from", F.col("_through") - F.col("n"))
        .drop("_before")
    )
    found = ranked.join(held, [*groups, "_slot"]).where(
        (F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_through"))
    )
    outputs = []
    for p in probabilities:
        pick = lambda side, p=p: F.max(
            F.when((F.col("_want.p") == p) & (F.col("_want.side") == side), F.col(value).cast("double"))
        )
        at = F.lit(p) * (F.max("_rows") - 1)
        outputs.append((pick(0) + (at - F.floor(at)) * (pick(1) - pick(0))).alias(quantile_name(p)))
    names = [quantile_name(p) for p in probabilities]
    return found.groupBy(*groups).agg(*outputs).select(*[F.col("_group")[c].alias(c) for c in by], *names)


def bounded_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same columns for values of a small domain, such as text lengths.

    The exact percentile runs over the counted values, so its buffer holds one entry per
    distinct value, never per row.
    """
    return _percentiles(value_counts(df, value, by), value, probabilities, by)


def _percentiles(counts: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    found = F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities]), F.col("n"))
    names = [F.get("_found", F.lit(i)).alias(quantile_name(p)) for i, p in enumerate(probabilities)]
    return counts.groupBy(*by).agg(found.alias("_found")).select(*by, *names)


def quantile_name(probability: float) -> str:
    return f"q{round(probability * 100)}"
