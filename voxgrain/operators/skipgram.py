"""Skip-gram word vectors whose parameters are sharded, so that no machine holds the vocabulary.

Neighbours within the window are counted once, as weights of (word, context) pairs. Words and contexts
are cut into blocks; word block i and context block j meet in the cell (i, j). Cells that share no
block are trained at the same time, each in a task that holds the two blocks' vectors and the cell's
pairs and updates both; a round visits all cells in as many jobs as there are blocks. Between jobs the
blocks lie in the shared folder, one row per block, in two folders that overwrite each other; and a
job's shuffle files are given up with it. So disk does not grow with the number of jobs.

A task goes through its cell in small batches of words. Each pair pulls its two vectors together with
its weight; contexts drawn for the batch by their frequency in the block push away, as many in weight
as ``negatives`` for each pair. Steps are scaled per vector by the gradients it has had (AdaGrad).
Draws depend on the cell, the round and the batch alone, so repeated tasks give the same vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from voxgrain.sources.files import materialize, scratch_folder

# Settings of the word vectors.
SIZE = 300
EPOCHS = 20
RATE = 0.05
MIN_COUNT = 2
WINDOW = 5
NEGATIVES = 5
FREQUENT = 1e-4
NOISE_POWER = 0.75

BLOCK = 4096
"""About so many words in a block of a small vocabulary; a task holds two blocks."""

BLOCKS = 16
"""Blocks of more words are made before there are more blocks than this, as every job rewrites all blocks."""

LARGER = 8
"""So many times larger do blocks become, which bounds what a task holds."""

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

PASSES = 5
"""Epochs that a cell is gone through in one visit."""

WORDS_PER_BATCH = 256
NOISE_PER_BATCH = 256

CONTEXTS_AT_ONCE = 2048
"""So many of a batch's contexts are held at once as vectors."""

SLAB = 1 << 20
"""About so many words of texts have their pairs added up together in a task."""

ROWS = 1 << 16
"""Rows of pairs that a task gives back at once."""

STATE = "kind int, block int, data binary"
WORDS, CONTEXTS, NOISE, PAIRS, TURNED = range(5)


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.filter(F.split(text, " "), lambda w: w != "").alias("words"))


def word_counts(df: DataFrame, text: str, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words between blanks that occur at least ``min_count`` times."""
    counted = _words(df, text).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _near_pairs(codes: np.ndarray, row: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, steps): distinct pairs of codes within ``window`` of each other in a row, and their summed window + 1 - distance.

    Codes are below ``size``; negative ones stand for words that are left out.
    """
    bits, keys = window.bit_length(), [np.zeros(0, np.int64)]
    for d in range(1, window + 1):
        first, second = codes[:-d], codes[d:]
        both = (row[:-d] == row[d:]) & (first >= 0) & (second >= 0)
        first, second = first[both], second[both]
        keys.append((np.minimum(first, second) * size + np.maximum(first, second) << bits) + (window + 1 - d))
    key = np.concatenate(keys)
    key.sort()
    pair = key >> bits
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    steps = np.add.reduceat(key & ((1 << bits) - 1), starts) if len(starts) else key
    return pair[starts] // max(1, size), pair[starts] % max(1, size), steps


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray]]:
    """(distinct words in order, place of each word, row of each word) of texts of about SLAB words together."""
    held: list[pa.ListArray] = []

    def cut() -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(held)
        held.clear()
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)], row

    words = 0
    for batch in batches:
        column, at = batch.column(0), 0
        ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        while at < len(column):
            end = min(len(column), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB - words)) + 1)
            held.append(column.slice(at, end - at))
            words += int(ends[end - 1] - (ends[at - 1] if at else 0))
            at = end
            if words >= SLAB:
                yield cut()
                words = 0
    if held:
        yield cut()


def word_pairs(df: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """(word, context, weight): how often words stand within ``window`` of each other, near ones counting more.

    At distance d a pair weighs (window - d + 1) / window, the share of windows of a random size up
    to ``window`` that hold it. Pairs are in both orders. Tasks add up the pairs of many texts as
    numbers before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, row in _slabs(batches):
            a, b, steps = _near_pairs(codes, row, window, len(words))
            for start in range(0, len(a), ROWS):
                part = slice(start, start + ROWS)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a[part])), words.take(pa.array(b[part])), pa.array(steps[part])], names=["a", "b", "steps"])

    counted = _words(df, text).mapInArrow(count, "a string, b string, steps long").repartition("a", "b").groupBy("a", "b").agg(F.sum("steps").alias("steps"))
    # A pair is counted in one order and given in both; a word beside itself is both at once.
    order = lambda word, context, times: F.struct(F.col(word).alias("word"), F.col(context).alias("context"), (F.col("steps") * times / window).alias("weight"))
    return counted.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(order("a", "b", 2))).otherwise(F.array(order("a", "b", 1), order("b", "a", 1)))))


def _packed_pairs(df: DataFrame, text: str, window: int, vocab: DataFrame, store: Callable[..., DataFrame]) -> DataFrame:
    """(apart, task, data): pairs of known words of many texts, by block of the lower word and how many blocks the other lies on.

    ``data`` has the places of both as int32 and their weight as float32, one after the other. Each of the distinct words
    of many texts looks up its number once; a pair of words is never a row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, row in _slabs(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([codes.astype(np.int32).tobytes()], pa.binary()), pa.array([row.astype(np.int32).tobytes()], pa.binary())],
                names=["slab", "words", "codes", "rows"],
            )

    slabs = store(_words(df, text).mapInArrow(cut, "slab string, words array<string>, codes binary, rows binary"), "texts")
    known = slabs.select("slab", F.posexplode("words").alias("at", "word")).join(vocab.select("word", "block", "place", "keep"), "word")
    numbers = known.groupBy("slab").agg(F.collect_list(F.struct("at", "block", "place", F.col("keep").cast("float").alias("keep"))).alias("numbers"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, block, place, keep = (batch.column(2).slice(i, 1).flatten().field(name).to_numpy(zero_copy_only=False) for name in ("at", "block", "place", "keep"))
                codes, row = (np.frombuffer(batch.column(k)[i].as_py(), np.int32) for k in (0, 1))
                order = np.lexsort((place, block))
                number = np.full(max(int(codes.max(initial=0)), int(at.max(initial=0))) + 1, -1)
                number[at[order]] = np.arange(len(at))
                block, place, keep = block[order], place[order], keep[order]
                a, b, steps = _near_pairs(number[codes], row, window, len(at))
                weight = (steps / window * keep[a] * keep[b]).astype(np.float32)
                apart, task, a, b = block[b] - block[a], block[a], place[a].astype(np.int32), place[b].astype(np.int32)
                order = np.lexsort((apart, task))
                apart, task, a, b, weight = (x[order] for x in (apart, task, a, b, weight))
                starts = np.flatnonzero((np.diff(task, prepend=-1) != 0) | (np.diff(apart, prepend=-1) != 0))
                for start, end in zip(starts, np.append(starts[1:], len(a))):
                    data = a[start:end].tobytes() + b[start:end].tobytes() + weight[start:end].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(apart[start])], pa.int32()), pa.array([int(task[start])], pa.int32()), pa.array([data], pa.binary())], names=["apart", "task", "data"])

    pairs = slabs.select("slab", "codes", "rows").join(numbers, "slab").select("codes", "rows", "numbers").mapInArrow(pair, "apart int, task int, data binary")
    return store(pairs, "word-pairs", "apart")


def blocks_of(known: int, block: int) -> int:
    """How many blocks so many words are cut into."""
    return -(-known // max(block, min(LARGER * block, -(-known // BLOCKS))))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries within give up their shuffle files when they end."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def _placed(counts: DataFrame, blocks: int) -> DataFrame:
    """(word, n, block, place, keep): a word's place in its block, and the share that is left of a frequent word."""
    total = counts.agg(F.sum("n").cast("double")).scalar()
    often = F.col("n") / total
    order = W.Window.partitionBy("block").orderBy("word")
    return counts.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")).select(
        "word", "n", "block", (F.row_number().over(order) - 1).alias("place"),
        F.least(F.lit(1.0), F.sqrt(FREQUENT / often) + FREQUENT / often).alias("keep"),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adagrad(block: np.ndarray, rows: np.ndarray, slopes: np.ndarray, rate: float) -> None:
    """Move ``rows`` along ``slopes``; a row's last number is the sum of its mean squares so far."""
    block[rows, -1] += (slopes * slopes).mean(axis=1)
    block[rows, :-1] += rate * slopes / np.sqrt(block[rows, -1:] + 1e-8)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of values of each)."""
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
    return rows[order][starts], np.add.reduceat(values[order], starts, axis=0)


def train_cell(
    words: np.ndarray, contexts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], noise: np.ndarray,
    rate: float, negatives: int, passes: int, seed: tuple[int, ...],
) -> float:
    """Train both blocks (rows x numbers and AdaGrad sum) in place; returns the last pass's loss per weight.

    ``pairs`` are (word place, context place, weight), ``noise`` the share of each context of the block. A batch has words
    that meet about as many contexts, and its contexts are gone through some at a time, which bounds what it holds.
    """
    if not len(pairs[0]):
        return 0.0
    cell, weight = _summed(pairs[0] * len(contexts) + pairs[1], pairs[2].astype(np.float32))
    a, b = cell // len(contexts), cell % len(contexts)
    heads = np.unique(a)
    edges = np.append(np.searchsorted(a, heads), len(a))
    total = np.add.reduceat(weight, edges[:-1])
    reach = np.cumsum(noise)
    batches = np.array_split(np.argsort(-np.diff(edges), kind="stable"), -(-len(heads) // WORDS_PER_BATCH))
    loss = 0.0
    for step in range(passes):
        rng = np.random.default_rng((*seed, step))
        loss = 0.0
        for number in rng.permutation(len(batches)):
            batch = np.sort(batches[number])
            lengths = edges[batch + 1] - edges[batch]
            places = np.repeat(edges[batch] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            places = places[np.argsort(b[places], kind="stable")]
            own = np.searchsorted(heads[batch], a[places])
            starts = np.flatnonzero(np.diff(b[places], prepend=-1))
            met, spans = b[places][starts], np.append(starts, len(places))
            column = np.repeat(np.arange(len(met)), np.diff(spans))
            u = words[heads[batch], :-1]
            to_words, to_contexts = np.zeros_like(u), np.empty((len(met), u.shape[1]), u.dtype)
            for first in range(0, len(met), CONTEXTS_AT_ONCE):
                some = slice(first, min(len(met), first + CONTEXTS_AT_ONCE))
                part = slice(spans[some.start], spans[some.stop])
                v, at = contexts[met[some], :-1], (own[part], column[part] - first)
                pull = u @ v.T
                score = _sigmoid(pull[at])
                pull[:] = 0
                pull[at] = (1 - score) * weight[places[part]]
                to_words += pull @ v
                to_contexts[some] = pull.T @ u
                loss -= float((np.log(score + 1e-12) * weight[places[part]]).sum())
            drawn = np.minimum(np.searchsorted(reach, rng.random(NOISE_PER_BATCH) * reach[-1], side="right"), len(noise) - 1)
            v = contexts[drawn, :-1]
            away = _sigmoid(u @ v.T)
            push = (away * (negatives * total[batch] / NOISE_PER_BATCH)[:, None]).astype(u.dtype)
            to_words -= push @ v
            loss -= float((np.log(1 - away + 1e-12) * (negatives * total[batch] / NOISE_PER_BATCH)[:, None]).sum())
            pushed, slopes = _summed(drawn, -(push.T @ u))
            near = np.minimum(np.searchsorted(met, pushed), len(met) - 1)
            here = met[near] == pushed
            to_contexts[near[here]] += slopes[here]
            _adagrad(words, heads[batch], to_words, rate)
            _adagrad(contexts, met, to_contexts, rate)
            _adagrad(contexts, pushed[~here], slopes[~here], rate)
    return loss / float(weight.sum())


def _fresh(blocks: DataFrame, size: int, seed: int) -> DataFrame:
    """(kind, block, data): words drawn small and even, contexts zero, AdaGrad sums zero; and each context's share of the noise."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, shares in zip(batch.column(0).to_pylist(), batch.column(1)):
                share = shares.values.field("share").to_numpy(zero_copy_only=False).astype(np.float32)
                words = np.zeros((len(share), size + 1), np.float32)
                words[:, :-1] = np.random.default_rng((seed, block)).uniform(-0.5, 0.5, (len(share), size)) / size
                for kind, data in ((WORDS, words), (CONTEXTS, np.zeros_like(words)), (NOISE, share)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["kind", "block", "data"])

    return blocks.mapInArrow(make, STATE)


def _trainer(size: int, rate: float, negatives: int, passes: int, seed: tuple[int, ...]):
    """Both blocks of a task, and the noise, as they are after ``passes`` through its cell."""

    def train(group: pa.Table) -> pa.Table:
        found: dict[int, list[bytes]] = {kind: [] for kind in (WORDS, CONTEXTS, NOISE, PAIRS, TURNED)}
        place = {}
        for kind, block, data in zip(group.column("kind").to_pylist(), group.column("block").to_pylist(), group.column("data")):
            found[kind].append(data.as_buffer())
            place[kind] = block
        both = [np.frombuffer(found[kind][0], np.float32).reshape(-1, size + 1).copy() for kind in (WORDS, CONTEXTS)]
        share = np.frombuffer(found[NOISE][0], np.float32)
        packed = [(np.frombuffer(data, np.int32).reshape(3, -1), kind) for kind in (PAIRS, TURNED) for data in found[kind]]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[side if kind == PAIRS else 1 - side] for p, kind in packed)]) for side in (0, 1))
        weight = np.concatenate([np.zeros(0, np.float32), *(p[2].view(np.float32) for p, _ in packed)])
        train_cell(both[0], both[1], (a, b, weight), share.astype(float), rate, negatives, passes, (*seed, place[WORDS]))
        kinds = (WORDS, CONTEXTS, NOISE)
        return pa.table({
            "kind": pa.array(kinds, pa.int32()), "block": pa.array([place[kind] for kind in kinds], pa.int32()), "data": pa.array([m.tobytes() for m in (*both, share)], pa.binary()),
        })

    return train


def train_vectors(
    df: DataFrame, text: str, size: int = SIZE, epochs: int = EPOCHS, min_count: int = MIN_COUNT, window: int = WINDOW,
    negatives: int = NEGATIVES, rate: float = RATE, block: int = BLOCK, passes: int = PASSES, seed: int = 42,
) -> DataFrame:
    """(word, vector): ``size`` floats for every word that occurs ``min_count`` times in the texts.

    ``epochs`` is how often every pair is gone through, ``passes`` of them at each visit of a cell.
    The driver holds no words and no vectors, only the number of blocks.
    """
    spark = df.sparkSession

    def stored(table: DataFrame, purpose: str, *parts: str, path: str | None = None) -> DataFrame:
        path = path or scratch_folder(spark, purpose)
        writer = table.write.partitionBy(*parts) if parts else table.write
        with _shuffles_dropped(spark):
            writer.mode("overwrite").parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    counts = materialize(word_counts(df, text, min_count))
    known = counts.count()
    if not known:
        return spark.createDataFrame([], "word string, vector array<float>")
    blocks = blocks_of(known, block)
    vocab = stored(_placed(counts, blocks), "vocabulary")
    pairs = _packed_pairs(df, text, window, vocab, stored)
    share = F.pow(F.col("n").cast("double"), F.lit(NOISE_POWER)).cast("float").alias("share")
    shares = vocab.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", share))).alias("shares"))
    # The blocks are read from one folder and written over what the other held.
    old, new = scratch_folder(spark, "vectors"), scratch_folder(spark, "vectors")
    state = stored(_fresh(shares, size, seed), "vectors", path=old)
    visits = [min(passes, epochs - at) for at in range(0, epochs, passes)]
    for visit, times in enumerate(visits):
        for stratum in range(blocks):
            of = F.when(F.col("kind") == WORDS, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks)))
            held = state.select(of.cast("int").alias("task"), "kind", "block", "data")
            # A pair is stored once: with its lower word's block as the words', and turned around with the other's.
            cell = pairs.where(F.col("apart") == stratum).select("task", F.lit(PAIRS).alias("kind"), F.lit(None).cast("int").alias("block"), "data")
            turned = pairs.where(F.col("apart") == (blocks - stratum) % blocks).select(
                (F.col("task") + F.col("apart")).cast("int").alias("task"), F.lit(TURNED).alias("kind"), F.lit(None).cast("int").alias("block"), "data"
            )
            state = stored(held.unionByName(cell).unionByName(turned).groupBy("task").applyInArrow(_trainer(size, rate, negatives, times, (seed, visit, stratum)), STATE), "vectors", path=new)
            old, new = new, old

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vectors = np.frombuffer(data, np.float32).reshape(-1, size + 1)[:, :-1]
                for start in range(0, len(vectors), 1024):
                    part = vectors[start:start + 1024]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), where, np.int32)), pa.array(np.arange(start, start + len(part), dtype=np.int32)), lists], names=["block", "place", "vector"]
                    )

    found = state.where("kind = 0").select("block", "data").mapInArrow(rows, "block int, place int, vector array<float>")
    return vocab.select("word", "block", "place").join(found, ["block", "place"]).select("word", "vector")
