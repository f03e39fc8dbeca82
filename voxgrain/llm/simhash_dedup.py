"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant that differs from each in at most r
bits, and two that share one differ in at most 2r. So all variants of every distinct fingerprint
within r bits are compared by equality. A variant's first bits name the bucket it is shuffled to;
instead of the variants themselves a fingerprint is sent once to each bucket that any of them falls
in, and the bucket's task makes its variants there. Fingerprints with a common variant are linked
to the smallest of them rather than all with each other, and a bucket reports one link per
fingerprint, so nothing grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import byte_values, components, forest, free_name, small, stored

SEED = 42
PER_BUCKET = 9
"""A bucket holds about 2**9 fingerprints of its own, so their number sets how many buckets there are."""

MOST_VARIANTS = 1 << 22
"""More variants than this in a bucket are made and compared in turns, by further bits."""


def simhash(data: bytes, words: int = 4) -> int:
    """64-bit fingerprint of UTF-8 bytes: A-Z lower-cased, cut at white space, shingled, repeats counted."""
    parts = data.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text as a signed long; no words give zero."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([simhash(t, words) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(votes, schema)


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks over the lowest ``bits`` bits by number of bits set, from none to ``most``."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)
    ]


def _colliding(fps: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint that shares a variant); variants flip at most ``left`` of the lowest ``bits`` bits."""
    masks = _flips(bits, int(left.max(initial=0)))
    made = sum(len(m) * int((left >= n).sum()) for n, m in enumerate(masks))
    if made > MOST_VARIANTS and bits > 8:
        found = []
        for value in range(16):
            flipped = np.bitwise_count(((fps >> np.uint64(bits - 4)) & np.uint64(15)) ^ np.uint64(value)).astype(np.int64)
            near = flipped <= left
            if near.sum() > 1:
                found.append(_colliding(fps[near], (left - flipped)[near], bits - 4))
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]) for i in (0, 1))
    low = fps & np.uint64((1 << bits) - 1)
    variants = np.concatenate([(low[left >= n][:, None] ^ m).ravel() for n, m in enumerate(masks)])
    owners = np.concatenate([np.repeat(fps[left >= n], len(m)) for n, m in enumerate(masks)])
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    starts = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
    lengths = np.diff(np.r_[starts, len(variants)])
    smallest = np.repeat(np.minimum.reduceat(owners, starts), lengths)
    linked = owners != smallest
    pairs = np.unique(np.stack([owners[linked], smallest[linked]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, other): links that connect all distinct fingerprints with at most ``radius`` bits between them.

    ``radius`` must be even. Fingerprints linked here are connected by such pairs and all such pairs are
    connected here; a group is not expanded into its pairs.
    """
    if radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    half = radius // 2
    prefix = max(4, min(24, distinct.count().bit_length() - PER_BUCKET))
    rest = 64 - prefix
    masks = np.concatenate(_flips(prefix, half)).tolist()
    sent = distinct.select(
        "fp", F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m: F.shiftrightunsigned("fp", rest).bitwiseXOR(m))).alias("bucket")
    )

    def link(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy().view(np.uint64))
        bucket = np.uint64(group.column("bucket")[0].as_py())
        left = half - np.bitwise_count((fps >> np.uint64(rest)) ^ bucket).astype(np.int64)
        node, other = forest(*_colliding(fps, left, rest)) if len(fps) > 1 else (fps[:0], fps[:0])
        return pa.table({"fp": pa.array(node.view(np.int64)), "other": pa.array(other.view(np.int64))})

    return sent.groupBy("bucket").applyInArrow(link, "fp long, other long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4
) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key reachable by links.

    Rows are linked if their fingerprints differ in at most ``radius`` bits. Null and empty texts
    have fingerprint zero and are linked like any other; null keys are passed over when the
    smallest is taken. Repeated rows stay. Other columns are not read. Very long texts are held by
    one task at a time, in whole. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    found = components(near_links(distinct.select("fp"), radius), "fp", "other")
    joined = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    named = joined.groupBy("label").agg(F.min("least").alias("component"))
    classes = joined.join(named, "label").select(F.col("fp").alias("class"), "component")
    return prints.join(classes, prints["fp"] == classes["class"]).select(key, "fp", "component")


def united(docs: DataFrame, key: str, text: str, finds: Sequence[Callable[..., DataFrame]]) -> DataFrame:
    """(key, component): the smallest key reachable by what any of ``finds`` links; keys are unique numbers."""
    links = None
    for find in finds:
        found = find(docs, key, text).where(F.col(key) != F.col("component")).select(key, F.col("component").alias("_other"))
        links = found if links is None else links.union(found)
    joined = components(stored(links, "links"), key, "_other")
    return docs.select(key).join(joined, F.col(key) == joined["node"], "left").select(key, F.coalesce("component", key).alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=near_duplicates, **settings) -> DataFrame:
    """One row of ``docs`` of each component, rows without a key included.

    It is the first by key (nulls last), text hash and the number the row was stored under; rows
    alike in all of these but the number are one document. ``find`` gives (key, ..., component) for
    keys that are unique. Rows are stored once, so that their numbers hold. All columns are kept,
    whatever their names; null and empty texts are one document; an empty table gives no rows. Very
    long texts are held by one task at a time, in whole.
    """
    row = free_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = find(rows, row, text, **settings).select(F.col(row).alias("_found"), "component")
    places = rows.select(F.col(row).alias("_at"), F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(text), F.col(row).alias("_kept")).alias("_place"))
    first = found.join(places, found["_found"] == places["_at"]).groupBy("component").agg(F.min("_place").getField("_kept").alias("_first")).select("_first")
    return rows.join(first, rows[row] == first["_first"], "left_semi").drop(row)
