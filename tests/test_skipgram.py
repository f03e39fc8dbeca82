"""Word pairs against counting by hand, and vectors by what stands near planted synonyms."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxgrain.operators import skipgram as sg
from voxgrain.sources.files import scratch_folder


def test_pairs_are_counted_by_distance(spark):
    texts = ["a b c a", "", None, "b", "d  a b c e f g h"]
    wanted = Counter()
    for text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            for d in range(1, 4):
                if i + d < len(words):
                    wanted[w, words[i + d]] += 4 - d
                    wanted[words[i + d], w] += 4 - d
    found = sg.word_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), "text", window=3)
    assert {(r["word"], r["context"]): round(r["weight"] * 3) for r in found.collect()} == wanted


def test_gradient_of_a_cell_lowers_its_loss():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.normal(size=(30, 8)) / 8, np.zeros((30, 1))], axis=1).astype(np.float32)
    contexts = np.zeros((40, 9), np.float32)
    a, b = rng.integers(0, 30, 400), rng.integers(0, 40, 400)
    pairs, noise = (a, (a + b % 3) % 40, np.ones(400, np.float32)), np.ones(40) / 40
    first = sg.train_cell(words, contexts, pairs, noise, 0.05, 5, 1, (1,))
    last = sg.train_cell(words, contexts, pairs, noise, 0.05, 5, 30, (2,))
    assert last < 0.8 * first
    assert sg.train_cell(words, contexts, tuple(p[:0] for p in pairs), noise, 0.05, 5, 1, (3,)) == 0.0


def planted(spark):
    """Words of a pair stand in the same surroundings but never together."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        topic = i % 6
        around = [f"about{topic}_{x}" for x in rng.integers(0, 8, 6)]
        around.insert(3, f"word{topic}{'ab'[rng.integers(0, 2)]}")
        rows.append((" ".join(around),))
    return spark.createDataFrame([*rows, ("once",), (None,)], "text string")


@pytest.mark.parametrize("block, epochs", [(4096, 10), (20, 30)])
def test_synonyms_are_neighbours(spark, block, epochs):
    found = sg.train_vectors(planted(spark), "text", size=16, epochs=epochs, block=block, passes=2).collect()
    vectors = {r["word"]: np.array(r["vector"]) for r in found}
    assert len(vectors) == len(found) == 6 * 8 + 12 and "once" not in vectors
    unit = {w: v / np.linalg.norm(v) for w, v in vectors.items()}
    for topic in range(6):
        near = sorted((w for w in unit if w.startswith("word")), key=lambda w: -unit[f"word{topic}a"] @ unit[w])  # noqa: B023
        assert near[:2] == [f"word{topic}a", f"word{topic}b"]


def test_vectors_do_not_depend_on_partitioning(spark):
    runs = []
    for parts in (1, 6):
        found = sg.train_vectors(planted(spark).repartition(parts), "text", size=6, epochs=2, block=25, passes=1).collect()
        runs.append({r["word"]: r["vector"] for r in found})
    assert runs[0].keys() == runs[1].keys() and all(np.allclose(runs[0][w], runs[1][w], atol=1e-4) for w in runs[0])


def test_no_words(spark):
    assert sg.train_vectors(spark.createDataFrame([("one two",), (None,)], "text string"), "text", size=4).collect() == []


def test_pairs_are_shuffled_once(spark):
    df = spark.createDataFrame([("a b a c",)], "text string")
    plan = sg.word_pairs(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r["word"], r["context"]): round(r["weight"] * 5) for r in sg.word_pairs(df, "text").collect()}["a", "a"] == 8


def test_blocks_lie_in_two_folders(spark, monkeypatch):
    made = []
    monkeypatch.setattr(sg, "scratch_folder", lambda session, purpose: made.append(purpose) or scratch_folder(session, purpose))
    sg.train_vectors(planted(spark), "text", size=4, epochs=2, block=20, passes=1).collect()
    assert made.count("vectors") == 2


def test_blocks_grow_before_their_number_does():
    assert [sg.blocks_of(n, 4096) for n in (1, 4096, 30_971, 65_536, 300_000, 524_288, 1_000_000)] == [1, 1, 8, 16, 16, 16, 31]
    assert sg.blocks_of(60, 20) == 3


def test_slabs_hold_all_texts(monkeypatch):
    monkeypatch.setattr(sg, "SLAB", 5)
    texts = [["b", "a", "b"], [], ["c"], ["a"] * 7, ["d", "a"], ["b"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["words"]) for part in (texts[:2], texts[2:])]
    found = []
    for words, codes, row in sg._slabs(iter(batches)):
        assert words.to_pylist() == sorted(set(words.to_pylist()))
        found += [[words[int(c)].as_py() for c in codes[row == r]] for r in range(row.max() + 1)]
    assert [t for t in found if t] == [t for t in texts if t]


def test_near_pairs_by_hand():
    rng = np.random.default_rng(4)
    codes, row, wanted = rng.integers(-1, 6, 300), np.repeat(np.arange(30), 10), Counter()
    for i in range(300):
        for d in range(1, 6):
            if i + d < 300 and row[i] == row[i + d] and min(codes[i], codes[i + d]) >= 0:
                wanted[tuple(sorted((codes[i], codes[i + d])))] += 6 - d
    a, b, steps = sg._near_pairs(codes, row, 5, 6)
    assert dict(zip(zip(a, b), steps)) == wanted
    assert [len(x) for x in sg._near_pairs(codes[:0], row[:0], 5, 0)] == [0, 0, 0]


def test_packed_pairs_are_the_weights_of_known_words(spark):
    """Words are rows, pairs are not: the pairs of a text lie packed by the blocks of their words."""
    df = spark.createDataFrame([("a b c a once",), ("b a d d",), (None,), ("d c",)], "text string")
    vocab = sg._placed(sg.word_counts(df, "text"), 3)
    known = {(r["block"], r["place"]): (r["word"], r["keep"]) for r in vocab.collect()}
    wanted = {frozenset((r["word"], r["context"])): r["weight"] for r in sg.word_pairs(df, "text").collect()}
    found = Counter()
    for r in sg._packed_pairs(df, "text", sg.WINDOW, vocab, lambda table, *_: table.localCheckpoint()).collect():
        a, b, weight = np.frombuffer(r["data"], np.int32).reshape(3, -1)
        for x, y, w in zip(a, b, weight.view(np.float32)):
            (one, keep_one), (other, keep_other) = known[r["task"], x], known[r["task"] + r["apart"], y]
            found[frozenset((one, other))] += w / keep_one / keep_other * (2 if one == other else 1)
    assert found == pytest.approx({pair: w for pair, w in wanted.items() if "once" not in pair}, rel=1e-5)


def test_a_cell_of_frequent_words_is_trained_in_parts():
    """256 words that all meet 3,000 contexts: no vector per pair is held."""
    words, contexts = np.zeros((256, 17), np.float32), np.zeros((3000, 17), np.float32)
    words[:, :16] = np.random.default_rng(3).normal(size=(256, 16)) / 16
    pairs = (np.repeat(np.arange(256), 3000), np.tile(np.arange(3000), 256), np.ones(256 * 3000, np.float32))
    tracemalloc.start()
    sg.train_cell(words, contexts, pairs, np.ones(3000) / 3000, 0.05, 5, 1, (1,))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and np.abs(contexts[:, :16]).max() > 0
