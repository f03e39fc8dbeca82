"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all rates that give every source its target of words, take those nearest to one in relative
entropy, each word counting alike: minimise sum size (r log r - r + 1). Its dual is convex, one
multiplier per source, and its solution tilts a document's rate exponentially, r = exp(multiplier
of its source). Newton's method solves the dual; gradient and curvature are sums over documents
that need only a source's word total, so documents are aggregated once and the iterations run in
parallel over the sources' totals.

Rates become whole copies by rounding with a draw of the document, and the few words by which a
source then misses its target are given to or taken from documents in the order of their draws.
Draws are hashes of the document, cut into slots: only the slot in which a source's correction ends
needs its documents in order, so no source is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from voxgrain.llm.common import WHITE, stored

ITERATIONS = 40
"""Newton steps per source; the error squares with each once it is small."""

SLOT_BITS = 14
"""Documents of a source fall into 2**14 slots by their draw."""


def word_count(text: str) -> Column:
    """Number of runs of characters other than white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Add each source's weight: the weights repeat along the sources by code point, null last.

    Ranges of the sources are numbered apart and then moved by the ranges before them.
    """
    order = [F.col("no_source"), F.col("source")]
    parts = stored(
        sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range, and ranges are as many as shuffle partitions.
    earlier = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("moved"))
    row = F.row_number().over(W.Window.partitionBy("part").orderBy(*order)) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return parts.withColumn("row", row).join(before, "part").select(
        *sources.columns, F.get(values, ((F.col("row") + F.col("moved")) % len(weights)).cast("int")).alias("weight")
    )


def _targets(sources: DataFrame, most: float) -> DataFrame:
    """Add ``target``: shares of all words by weight, at most ``most`` times the source's own words.

    The excess of capped sources is shared again by weight among the others until none is above.
    Each round is one aggregate; a source once capped stays so.
    """
    cap = F.col("source_size") * float(most)
    level = 0.0
    while True:
        capped = F.col("weight") * level >= cap
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["all"] or not row["open"]:
            break
        new = (row["all"] - row["held"]) / row["open"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def _multiplier(size: Column, target: Column) -> Column:
    """The dual's solution for one source: minus infinity stands for no words at all."""
    gradient = lambda x: size * F.exp(x) - target
    # A step down is at most one, as the curvature is tiny where the rate is far below the target.
    step = lambda x, _: x - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gradient(x) / (size * F.exp(x))))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.lit(0.0), step)
    return F.when((size > 0) & (target > 0), solved)


def _draw(key: str, text: str) -> Column:
    """A hash of the document; rows alike in key and text have the same."""
    return F.xxhash64(F.col(key), F.xxhash64(text))


def balance(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, key: str = "doc_id",
    text: str = "text", source: str = "source",
) -> DataFrame:
    """(key, size, source_size, target, copies, extra, taken, draw, source) per row of ``docs``.

    ``copies`` whole copies and the first ``extra`` words of one more are taken, ``taken`` words
    together, never above ``most`` times the size. A source's taken words are its target, rounded.
    Null texts have no words and one copy if their source is not thinned; null sources are one
    source, the last. Rows alike in key and text have the same draw and are treated alike but for
    a correction that ends among them. Other columns are not read. Without words nothing is taken.
    """
    draw = _draw(key, text).alias("draw")
    sized = stored(
        docs.select(
            F.col(key).alias("key"), F.col(source).isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
            word_count(text).alias("size"), draw,
        ), "sizes",
    )
    name = ["no_source", "source"]
    totals = stored(sized.groupBy(*name).agg(F.sum("size").alias("source_size")), "totals")
    rated = _targets(stored(_numbered(totals, weights), "weights"), most)
    rated = stored(
        rated.withColumn("multiplier", _multiplier(F.col("source_size").cast("double"), F.col("target")))
        .select(*name, "source_size", "target", F.coalesce(F.least(F.exp("multiplier"), F.lit(float(most))), F.lit(0.0)).alias("rate")),
        "rates",
    )
    place = F.shiftrightunsigned("draw", 11) / float(1 << 53)
    copies = F.least(F.floor(F.col("rate") + place), F.lit(int(most)))
    rounded = stored(
        sized.join(rated.select(*name, "rate"), name)
        .select("key", *name, "size", "draw", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("long").alias("copies")),
        "copies",
    )
    whole = F.col("copies") * F.col("size")
    slot = F.shiftrightunsigned(F.xxhash64("draw"), 64 - SLOT_BITS).alias("slot")
    # What may still be given to, and taken from, the documents of a slot.
    room, stock = (F.lit(int(most)) - F.col("copies")) * F.col("size"), whole
    slots = stored(
        rounded.groupBy(*name, slot).agg(F.sum(whole).alias("taken"), F.sum(room).alias("room"), F.sum(stock).alias("stock")), "slots"
    )
    missing = slots.groupBy(*name).agg(F.sum("taken").alias("taken")).join(rated, name).select(
        *name, (F.round("target").cast("long") - F.col("taken")).alias("missing")
    )
    along = W.Window.partitionBy(*name).orderBy("slot").rowsBetween(W.Window.unboundedPreceding, -1)
    amount = F.when(F.col("missing") >= 0, F.col("room")).otherwise(F.col("stock"))
    changed = slots.join(missing, name).withColumn("amount", amount).withColumn(
        "left", F.abs("missing") - F.coalesce(F.sum("amount").over(along), F.lit(0))
    ).where(F.col("left") > 0).select(*name, "slot", F.signum("missing").cast("long").alias("sign"), "left", (F.col("left") < F.col("amount")).alias("last"))
    changed = stored(changed, "corrections")
    marked = rounded.withColumn("slot", slot).join(changed, [*name, "slot"], "left").withColumn(
        "amount", F.when(F.col("sign") > 0, room).when(F.col("sign") < 0, stock).otherwise(F.lit(0))
    )
    inside = W.Window.partitionBy(*name, "slot").orderBy("draw", "key").rowsBetween(W.Window.unboundedPreceding, -1)
    ending = marked.where("last").withColumn("used", F.coalesce(F.sum("amount").over(inside), F.lit(0)))
    others = marked.where(~F.coalesce("last", F.lit(False))).withColumn("used", F.lit(0).cast("long"))
    given = F.coalesce(F.col("sign") * F.greatest(F.lit(0), F.least(F.col("amount"), F.col("left") - F.col("used"))), F.lit(0))
    taken = others.unionByName(ending).withColumn("taken", whole + given)
    full = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.expr("taken div size"))
    return taken.join(rated.select(*name, "source_size", "target"), name).select(
        F.col("key").alias(key), "size", "source_size", "target", full.alias("copies"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("taken") % F.col("size")).alias("extra"), "taken", "draw",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", **settings
) -> DataFrame:
    """``docs`` with every row repeated as often as it is taken; a part copy has the text's first words.

    A part copy's ``length``, if there is such a column, is set anew.

    Rows alike in key, text and source are taken alike, each as often as the one taken most; so
    rows without a key are told apart by their text and source. All columns are kept, whatever
    their names; null texts stay null; an empty table gives no rows. A text is cut by one task, in
    whole.
    """
    alike = [F.col(key).alias("_key"), F.col("draw").alias("_draw"), F.col("source").alias("_source")]
    plan = balance(docs, key=key, text=text, source=source, **settings)
    plan = plan.groupBy(*alike).agg(F.max(F.struct("copies", "extra")).alias("_most"))
    plan = plan.select("_key", "_draw", "_source", F.col("_most.copies").alias("_copies"), F.col("_most.extra").alias("_extra"))
    plan = plan.where((F.col("_copies") > 0) | (F.col("_extra") > 0))
    parts = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_copies").cast("int")), F.when(F.col("_extra") > 0, F.array("_extra")).otherwise(F.array().cast("array<long>")))
    # The caller's columns travel as one, so that no name of theirs meets one of these.
    carried = docs.select(F.struct(*docs.columns).alias("_doc"), _draw(key, text).alias("_hash"), F.col(key).alias("_id"), F.col(source).alias("_from"))
    same = (F.col("_hash") == F.col("_draw")) & F.col("_id").eqNullSafe(F.col("_key")) & F.col("_from").eqNullSafe(F.col("_source"))
    rows = carried.join(plan, same).withColumn("_part", F.explode(parts))
    content, whole = F.col("_doc")[text], F.col("_part") < 0
    words = F.split(F.regexp_replace(content, f"^[{WHITE}]+", ""), f"[{WHITE}]+")
    first = F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " ")
    new = {text: F.when(whole, content).otherwise(first)}
    if length in docs.columns:
        new[length] = F.when(whole, F.col("_doc")[length]).otherwise(F.length(first)).cast(docs.schema[length].dataType)
    return rows.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
