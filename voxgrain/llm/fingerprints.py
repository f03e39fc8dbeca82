"""Document fingerprints: weighted SimHash, and a search by permuted block tables.

A term is a word or a pair of neighbouring words. Each term's hash votes on 64 signed bits with the
weight sqrt(times it occurs); a bit is set if its votes are positive. For the search the bits are cut
into more blocks than may differ; every choice of the blocks that are equal in a match is a table,
whose permutation moves these blocks to the front as the key of an equality join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import byte_values, small, stored

BUCKETS_PER_PARTITION = 8


def fingerprint(data: bytes) -> int:
    """The 64-bit fingerprint of UTF-8 bytes; A-Z count as a-z, no words give zero."""
    words = data.lower().split()
    if not words:
        return 0
    terms = Counter(words)
    terms.update(map(b" ".join, zip(words, words[1:])))
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, terms)), np.uint64)
    weights = np.sqrt(np.fromiter(terms.values(), np.float32, len(terms)))
    votes = np.zeros(64, np.float64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[start:start + (1 << 16)] @ bits.astype(np.float32)
    set_bits = votes * 2 > float(weights.sum(dtype=np.float64))
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text as a signed long; null texts are empty."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(t) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(vote, schema)


def block_tables(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """Per table the (shift, mask) of the blocks that must be equal; all tables together miss no match."""
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    cuts = [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]
    return [list(chosen) for chosen in combinations(cuts, blocks - radius)]


def search(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query_fp, fp, distance): all distinct fingerprints within ``radius`` bits of a distinct query's.

    Both tables have a column ``fp``; keys are joined on by the caller, so repeated fingerprints
    cost nothing here. A match may come from several tables and is given once.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits may differ")
    tables = block_tables(blocks, radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = []
        for number, chosen in enumerate(tables):
            parts = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask)) for low, mask in chosen]
            keys.append(F.xxhash64(F.lit(number), *parts))
        return df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("block"))

    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    pairs = keyed(queries, "query_fp").join(keyed(prints, "fp"), "block").where(distance <= radius)
    return pairs.select("query_fp", "fp", distance.alias("distance")).distinct()


def neighbour_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document next to an edited copy and to the document after it, by descending key.

    (key, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next). The edited text replaces
    the last third of the code points by as many from the start of the next document, or by all of
    a shorter one; the document after the last is the first. Keys are cut into ranges of about the
    same number of documents; each range also gets the first document of the next one that has any,
    so neighbours meet without all rows in one place, and each text is shuffled once.

    Null texts are empty. Keys are whole numbers; null keys come after all others. Rows of one key
    are ordered by their text's hash. One document is its own neighbour. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select((-order.cast("double")).alias("falling"), order.alias("order"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(ids.stat.approxQuantile("falling", [i / n for i in range(1, n)], 0.1 / n))) or [0.0]
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="falling", outputCol="bucket")
    # One row per bucket, of which there are at most n.
    firsts = [(r["first"], int(r["bucket"])) for r in cut.transform(ids).groupBy("bucket").agg(F.max("order").alias("first")).orderBy("bucket").collect()]
    borrowed = spark.createDataFrame(
        [(first, float(firsts[i - 1][1])) for i, (first, _) in enumerate(firsts)], "first long, also double"
    )
    keyed = cut.transform(docs.select(key, text, (-order.cast("double")).alias("falling"), order.alias("order")))
    keyed = keyed.join(F.broadcast(borrowed), F.col("order") == F.col("first"), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    also = F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("halo")))
    rows = keyed.select(key, text, "order", F.explode(F.array_compact(F.array(own, also))).alias("to")).select(key, text, "order", "to.*")
    schema = T.StructType([
        docs.schema[key], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fp", T.LongType()), T.StructField("edited_fp", T.LongType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])
    names = schema.fieldNames()

    def signed(value: int) -> int:
        return value - (1 << 64) if value >> 63 else value

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held, kind = None, pa.int64()
        for batch in small(batches):
            kind = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for k, content, home, extra in zip(*columns):
                content = content or ""
                fp = fingerprint(content.encode())
                if held and held[2] == home:
                    k0, old, _, fp0 = held
                    third = len(old) // 3
                    edited = (old[:len(old) - third] + content[:third]).encode()
                    efp = fingerprint(edited)
                    found.append((k0, len(old), hashlib.sha256(edited).hexdigest(), signed(fp0), signed(efp), likeness(fp0, efp), likeness(fp0, fp)))
                held = None if extra else (k, content, home, fp)
            if found:
                arrays = [pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*found))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                found = []

    # Within a bucket the own documents come first, then the one borrowed from the next.
    dealt = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "halo", F.desc("order"), F.xxhash64(text), text)
    # Of several rows with the borrowed key the first one counts; the others find nothing held.
    return dealt.select(key, text, "bucket", "halo").mapInArrow(report, schema)


def stored_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints written once, for searches that read them again and again."""
    return stored(document_fingerprints(docs, key, text), "prints")
