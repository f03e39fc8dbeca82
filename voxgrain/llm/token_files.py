"""Token-id files: Simple-8b words in blocks, kept in Parquet rows.

A row of a file holds some whole documents in order: their ids and counts, where the row starts
among the ids of its writing task, and a payload. The payload is

    b"S8B1", uint32 blocks, then per block uint32 ids, uint32 words, uint32 escapes,
    uint64 word offset; then all words (uint64), all escapes' places (uint32) and values (uint64)

all little-endian. Each 64-bit word has a 4-bit selector and 60 bits of ids of one width. An id of
more than 60 bits is stored as zero and its value among the block's escapes, so a decoder needs no
branch per id: counts and widths come from the selectors by table, everything else is array work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import ZSTD, small, text_values, with_base
from voxgrain.llm.tokens import encoder

# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
BLOCK_IDS = 8192
ROW_IDS = 1 << 18
"""A row is closed when it holds so many ids; a longer document has a row of its own."""

HEAD = np.dtype([("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4"), ("offset", "<u8")])


def _words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of one block; each takes as many ids as fit."""
    n = len(ids)
    places = np.arange(n)
    best, selector = np.ones(n, np.int64), np.full(n, 15)
    for s in range(14, -1, -1):
        if n < COUNTS[s]:
            break
        # Where each run of ids narrow enough ends: at the next id too wide, or behind the last.
        wide = np.r_[np.flatnonzero(ids >> np.uint64(WIDTHS[s])), n]
        free = np.diff(wide, prepend=-1) - 1
        long = np.flatnonzero(free >= COUNTS[s])
        if not len(long):
            break  # more ids of fewer bits fit nowhere either
        fitting = free[long] - COUNTS[s] + 1
        first = np.repeat(wide[long] - free[long] - (np.cumsum(fitting) - fitting), fitting) + np.arange(fitting.sum())
        best[first], selector[first] = COUNTS[s], s
    jump, starts, at = (places + best).tolist(), [], 0
    while at < n:
        starts.append(at)
        at = jump[at]
    chosen = selector[starts]
    counts, widths = COUNTS[chosen], WIDTHS[chosen].astype(np.uint64)
    first = np.repeat(np.array(starts), counts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    shifted = ids[first + step] << (step.astype(np.uint64) * np.repeat(widths, counts))
    body = np.add.reduceat(shifted, np.cumsum(counts) - counts)
    return (chosen.astype(np.uint64) << np.uint64(60)) | body


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Payload of any unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    heads, words, places, values, offset = [], [], [], [], 0
    for start in range(0, len(ids), block):
        part = ids[start:start + block]
        escaped = np.flatnonzero(part >> np.uint64(60))
        if len(escaped):
            places.append(escaped.astype("<u4"))
            values.append(part[escaped])
            part = part.copy()
            part[escaped] = 0
        coded = _words(part)
        heads.append((len(part), len(coded), len(escaped), offset))
        words.append(coded)
        offset += len(coded)
    body = [np.array(heads, HEAD).tobytes(), *[w.astype("<u8").tobytes() for w in words]]
    return b"".join([MAGIC, struct.pack("<I", len(heads)), *body, *[p.tobytes() for p in places], *[v.astype("<u8").tobytes() for v in values]])


def decode_ids(payload: bytes) -> np.ndarray:
    """The ids of a payload, as unsigned 64-bit numbers."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    (blocks,) = struct.unpack_from("<I", payload, 4)
    heads = np.frombuffer(payload, HEAD, blocks, 8)
    total, escapes = int(heads["words"].sum()), int(heads["escapes"].sum())
    at = 8 + blocks * HEAD.itemsize
    words = np.frombuffer(payload, "<u8", total, at)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    step = (np.arange(int(ends[-1]) if total else 0) - np.repeat(ends - counts, counts)).astype(np.uint64)
    width = np.repeat(WIDTHS[selector].astype(np.uint64), counts)
    ids = (np.repeat(words, counts) >> (step * width)) & ((np.uint64(1) << width) - np.uint64(1))
    if escapes:
        at += 8 * total
        place = np.frombuffer(payload, "<u4", escapes, at).astype(np.int64)
        first = np.cumsum(heads["ids"].astype(np.int64)) - heads["ids"]
        ids[place + np.repeat(first, heads["escapes"])] = np.frombuffer(payload, "<u8", escapes, at + 4 * escapes)
    return ids


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> None:
    """Write all documents' ids in ascending key order, nulls first.

    Null texts are empty: they have their end id alone. Rows of the same key are ordered by their
    text's hash. Texts are shuffled once, by ranges of the key; each task then tokenises and codes
    one range. Other columns are not read.
    """
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("row", T.LongType()), T.StructField("first", T.LongType()),
        T.StructField("ids", T.LongType()), T.StructField("docs", T.ArrayType(key_type)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, first = TaskContext.get().partitionId(), 0, 0
        keys, coded, held = [], [], 0
        kind = pa.null()

        def closed() -> pa.RecordBatch:
            counts = [len(c) // 4 for c in coded]
            payload = encode_ids(np.frombuffer(b"".join(coded), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([row]), pa.array([first]), pa.array([held]), pa.array([keys], pa.list_(kind)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=schema.fieldNames(),
            )

        words = encoder(tokenizer)
        for batch in small(batches):
            kind = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), words.encode(text_values(batch.column(1)))):
                keys.append(k)
                coded.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= ROW_IDS:
                    yield closed()
                    row, first = row + 1, first + held
                    keys, coded, held = [], [], 0
        if keys:
            yield closed()

    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc()).sortWithinPartitions(F.col(key).asc(), F.xxhash64(text))
    ordered.mapInArrow(code, schema).write.options(**ZSTD).parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): every document of the files, ids as little-endian 32-bit bytes.

    ``start`` counts the ids of all documents before it. No documents give no rows.
    """
    rows = spark.read.parquet(path)
    schema = T.StructType([
        T.StructField(key, rows.schema["docs"].dataType.elementType), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.array(batch.column(1)[i].as_py(), np.int64)
                ends = np.cumsum(counts)
                ids = decode_ids(batch.column(2)[i].as_py()).astype("<u4").tobytes()
                parts = [ids[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(batch.column(3)[i].as_py() + ends - counts), pa.array(counts), pa.array(parts, pa.binary())],
                    names=schema.fieldNames(),
                )

    placed = with_base(rows, "part", "ids", "base")
    return placed.select("docs", "counts", "payload", F.col("base") + F.col("first")).mapInArrow(decode, schema)
