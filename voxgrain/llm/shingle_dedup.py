"""Near duplicates by similarity of their word shingles: MinHash bands, then exact comparison.

A document is its set of shingles (runs of words). Each of BANDS * ROWS hash functions gives a set's
smallest value; sets that agree in all values of a band meet in a bucket. At similarity s a pair
meets with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.8. Pairs that meet are linked if their
exact similarity reaches the threshold.

A bucket is not expanded into its pairs. First each set is compared with one of the bucket, the
pivot: the set that most others meet in their buckets, which in a group of copies is the one most
like their common source. Only pairs that this does not connect can still matter, and exact bounds
rule them out before they are compared:

- 1 - similarity is a metric, so two sets are at least as far apart as their distances to the pivot differ;
- shingles that no other set has cannot be common ones, so what a set shares with any other is at
  most the number of the rest;
- the rest is counted by CELLS parts of the hash range, and two sets share at most the smaller of
  their counts in each. Copies that were changed in different places miss different parts.

The bounds are taken between blocks of a bucket's sets, and what they leave is compared exactly. So
the number of comparisons follows the number of sets, also where a group's members are near to a
common source but not to each other, and no pair is skipped that could be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import byte_values, components, small, stored
from voxgrain.llm.tokens import forget

SEED = 42
BANDS = 30
ROWS = 6

CELLS = 64
LEFT_BLOCK, BLOCK = 1024, 4096
"""About so many sets of a bucket are bounded at a time, of those left over and of all."""

_DRAWS = np.random.default_rng(SEED)
_FLIPS = _DRAWS.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _DRAWS.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(data: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of UTF-8 bytes: A-Z lower-cased, cut at white space, shingled; shorter texts are one shingle."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    width = min(words, len(parts))
    spans = zip((ends - lengths)[:len(parts) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed number per band of a set's smallest values."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(hashes), 512):
        drawn = (hashes[start:start + 512] ^ _FLIPS[:, None]) * _FACTORS[:, None]
        np.minimum(least, drawn.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, set, bands): the 64-bit digest of every row's shingle set and its bands; no words give zero and no bands."""
    schema = T.StructType([docs.schema[key], T.StructField("set", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in small(batches):
            found = [shingles(t, words) for t in byte_values(batch.column(1))]
            names = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) if len(f) else 0 for f in found], np.uint64).view(np.int64)
            drawn = pa.array([bands(f) if len(f) else [] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), drawn], names=schema.names)

    return docs.select(key, text).mapInArrow(draw, schema)


def _members(docs: DataFrame, key: str, text: str, words: int, chosen: DataFrame) -> DataFrame:
    """(set, shingles) of the ``chosen`` (row, set), read again from their texts."""
    texts = docs.select(F.col(key).alias("row"), F.col(text).alias("text")).join(chosen, "row").select("set", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [shingles(t, words).view(np.int64) for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["set", "shingles"])

    return texts.mapInArrow(cut, "set long, shingles array<long>")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) of distinct pairs of sets: their exact similarity."""
    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    shared = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return shared.select("a", "b", (F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("near"))


def _shared_cells(sets: DataFrame) -> DataFrame:
    """(set, shared, cells): shingles that another of the ``sets`` has too, in all and per part of the hash range."""
    single = sets.select("set", F.explode("shingles").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("shingle")
    cell = F.pmod(F.col("shingle"), F.lit(CELLS))
    counts = [F.count_if(cell == i).cast("int").alias(f"cell{i}") for i in range(CELLS)]
    counted = single.join(common, "shingle", "left_semi").groupBy("set").agg(F.count(F.lit(1)).alias("shared"), *counts)
    return counted.select("set", "shared", F.array(*[f"cell{i}" for i in range(CELLS)]).alias("cells"))


def _possible(likeness: float):
    """Pairs of one block of sets left over with one block of all that no bound rules out."""

    def compare(group: pa.Table) -> pa.Table:
        whole = {c: group.column(c).to_numpy() for c in ("set", "own", "near", "n", "shared", "first")}
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, CELLS)
        x, y = np.flatnonzero(whole["first"]), np.flatnonzero(~whole["first"])
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in x.tolist():
            small_enough = np.abs(whole["near"][y] - whole["near"][i]) <= 1 - likeness + 1e-9
            wanted = likeness / (1 + likeness) * (whole["n"][y] + whole["n"][i]) - 1e-6
            fits = y[small_enough & (whole["own"][y] != whole["own"][i]) & (np.minimum(whole["shared"][y], whole["shared"][i]) >= wanted)]
            wanted = likeness / (1 + likeness) * (whole["n"][fits] + whole["n"][i]) - 1e-6
            fits = fits[np.minimum(cells[fits], cells[i]).sum(axis=1) >= wanted]
            heads.append(np.full(len(fits), whole["set"][i]))
            tails.append(whole["set"][fits])
        one, two = np.concatenate(heads), np.concatenate(tails)
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    return compare


def near_links(buckets: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b): links that connect all sets of a common bucket whose similarity is at least ``likeness``.

    ``buckets`` has (band, set, met), where ``met`` is the number of sets of the bucket.
    """
    sizes = sets.select("set", F.size("shingles").alias("n"))
    popular = stored(buckets.groupBy("set").agg(F.sum("met").alias("popular")), "popular")
    pivots = buckets.join(popular, "set").groupBy("band").agg(F.max(F.struct("popular", "set")).getField("set").alias("pivot"))
    held = stored(buckets.join(pivots, "band").where("set <> pivot"), "bucket-members")
    measured = stored(_measured(held.select(F.col("set").alias("a"), F.col("pivot").alias("b")).distinct(), sets), "pivot-pairs")
    links = measured.where(F.col("near") >= likeness).select("a", "b")
    # Sets with a common label are connected: the label is the most popular pivot that a set is linked to,
    # or that this one is linked to. Pairs within a label need no comparison.
    ranked = links.join(popular, links["b"] == popular["set"]).groupBy("a").agg(F.max(F.struct("popular", "b")).getField("b").alias("label"))
    label = stored(ranked, "labels")
    further = label.select(F.col("a").alias("label"), F.col("label").alias("next"))
    label = stored(label.join(further, "label", "left").select("a", F.coalesce("next", "label").alias("label")), "joined-labels")
    own = label.select(F.col("a").alias("set"), F.col("label").alias("own"))
    theirs = label.select(F.col("a").alias("pivot"), F.col("label").alias("theirs"))
    known = measured.select(F.col("a").alias("set"), F.col("b").alias("pivot"), "near")
    placed = held.join(known, ["set", "pivot"]).join(own, "set", "left").join(theirs, "pivot", "left").select(
        "band", "set", "near", "met", F.coalesce("own", "set").alias("own"), F.coalesce("theirs", "pivot").alias("theirs")
    )
    placed = stored(placed, "placed-members")
    mixed = placed.where("own <> theirs").select("band").distinct()
    open_members = stored(placed.join(mixed, "band", "left_semi"), "mixed-members")
    asked = open_members.select("set").distinct()
    cells = _shared_cells(sets.join(asked, "set", "left_semi")).join(sizes, "set").where(F.col("shared") >= likeness * F.col("n") - 1e-6)
    members = stored(open_members.join(cells, "set"), "open-members")
    blocks = lambda most: F.ceil(F.col("met") / most).cast("long")
    place = lambda most: F.pmod(F.xxhash64("set"), blocks(most))
    all_places = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), blocks(most) - 1))
    left = members.where("own <> theirs").withColumns({"first": F.lit(True), "x": place(LEFT_BLOCK)}).withColumn("y", all_places(BLOCK))
    every = members.withColumns({"first": F.lit(False), "y": place(BLOCK)}).withColumn("x", all_places(LEFT_BLOCK))
    used = left.select("band", "x").distinct()
    pairs = left.unionByName(every.join(used, ["band", "x"], "left_semi")).groupBy("band", "x", "y").applyInArrow(_possible(likeness), "a long, b long")
    others = stored(pairs.distinct(), "other-pairs")
    return links.union(_measured(others, sets).where(F.col("near") >= likeness).select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, likeness: float = 0.8) -> DataFrame:
    """(key, set, component): every row with its shingle set and the smallest key reachable by links.

    Rows are linked if their sets of ``words``-word shingles have a Jaccard similarity of at least
    ``likeness``. Keys are unique and not null. Null and empty texts are linked with each other.
    Other columns are not read. Very long texts are held by one task at a time, in whole. An empty
    table gives no rows.
    """
    prints = stored(_sets(docs, key, text, words), "sets")
    distinct = stored(prints.groupBy("set").agg(F.min(key).alias("row"), F.first("bands").alias("bands")), "distinct-sets")
    banded = distinct.select("set", F.explode("bands").alias("band"))
    common = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.col("n").alias("met"))
    buckets = stored(banded.join(common, "band"), "buckets")
    chosen = distinct.select("row", "set").join(buckets.select("set").distinct(), "set", "left_semi")
    sets = stored(_members(docs, key, text, words, chosen), "members")
    links = stored(near_links(buckets, sets, likeness), "near-links")
    found = components(links, "a", "b")
    joined = distinct.join(found, distinct["set"] == found["node"], "left").select("set", "row", F.coalesce("component", "set").alias("label"))
    named = joined.groupBy("label").agg(F.min("row").alias("component"))
    classes = joined.join(named, "label").select(F.col("set").alias("class"), "component")
    return prints.join(classes, prints["set"] == classes["class"]).select(key, "set", "component")
