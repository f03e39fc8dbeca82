"""Packing: concatenate all documents' token ids and cut them into sequences of one length.

Two passes. The first tokenises each document once and writes its ids with the writing task's
number and the document's place among that task's ids. The tasks' totals, summed up, give every
document its place in the concatenation of everything; the second pass cuts at the sequence
boundaries. A document that crosses boundaries gives one record per sequence it lies in. Nothing
is shuffled but one total per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import small, stored, text_values, with_base
from voxgrain.llm.tokens import encoder


def token_table(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n, part, place): every document's ids with the end id, written once.

    ``place`` counts the ids before the document among those of its writing task ``part``.
    """
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, key_type), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("part", T.LongType()), T.StructField("place", T.LongType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        words = encoder(tokenizer)
        for batch in small(batches):
            ids = [i + end for i in words.encode(text_values(batch.column(1)))]
            n = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(ids), part)), pa.array(places)],
                names=[key, "ids", "n", "part", "place"],
            )

    return stored(docs.select(key, text).mapInArrow(encode, schema), "tokens")


def cut(tokens: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): the pieces of a token table."""
    schema = T.StructType([
        tokens.schema[key], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    names = schema.fieldNames()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, at = (batch.column(i).to_numpy() for i in (2, 3))
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = at[row] // length + step
            begin = np.maximum(sequence * length, at[row])
            size = np.minimum((sequence + 1) * length, (at + n)[row]) - begin
            start = begin - at[row]
            ids = batch.column(1).to_pylist()
            cuts = [ids[r][4 * a:4 * (a + s)] for r, a, s in zip(row.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(cuts, pa.binary()),
                 pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)],
                names=names,
            )

    placed = with_base(tokens, "part", "n", "base")
    return placed.select(key, "ids", "n", F.col("base") + F.col("place")).mapInArrow(pieces, schema)


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids; only the last sequence is short.

    A null or empty text has its end id alone. Repeated rows and ids are documents of their own.
    Other columns are not read. An empty table gives no pieces. A document of any length is held
    whole by one task, as text and ids.
    """
    return cut(token_table(docs, tokenizer, end_id, key, text), length, key)
