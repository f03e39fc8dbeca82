"""Hard negatives against all scores, one by one, and the tree's bounds against plain products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.inputs import CLASHING, SMALL, rows_of
from voxgrain.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_anchor, relabel=lambda key, label: label, positives=5, negatives=3):
    held = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        held[(key, relabel(key, label), tuple(math.floor(256 * x) for x in vector))] = None
    rows, found = list(held), []
    for anchor in rows:
        if not is_anchor(anchor[0]):
            continue
        score = lambda r: sum(a * b for a, b in zip(anchor[2], r[2]))  # noqa: E731, B023
        same = [r for r in rows if len(r[2]) == len(anchor[2]) and r[1] == anchor[1] and r[0] != anchor[0]]
        others = [(score(r), r[0]) for r in rows if len(r[2]) == len(anchor[2]) and r[1] != anchor[1]]
        for p in sorted(same, key=lambda r: (-score(r), r[0]))[:positives]:
            fits = sorted([o for o in others if 50 * score(p) <= 100 * o[0] <= 95 * score(p)], key=lambda o: (-o[0], o[1]))
            found += [(anchor[0], p[0], rank, o[1], score(p), o[0]) for rank, o in enumerate(fits[:negatives], 1)]
    return found


def changed(key, label):
    return (label + 1) % 10 if key % 7 == 0 else label


@pytest.mark.parametrize("pivots, anchors, candidates", [(256, 512, 32768), (3, 2, 40), (1, 512, 90)])
def test_negative_query(spark, monkeypatch, pivots, anchors, candidates):
    for name, value in (("PIVOTS", pivots), ("ANCHORS", anchors), ("CANDIDATES", candidates)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = rows_of(queries.op11_hard_negatives(spark, SMALL))
    assert len(found) > 50 and sorted(found) == sorted(plain(rows, lambda k: k % 50 == 0, changed))


@pytest.mark.parametrize("pivots, anchors", [(256, 512), (4, 8)])
def test_negatives_in_clusters(spark, monkeypatch, pivots, anchors):
    """Vectors in tight groups, where bounds rule out most; with ties, repeats and rows that take no part."""
    monkeypatch.setattr(hard_negatives, "PIVOTS", pivots)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rng = np.random.default_rng(4)
    rows = []
    for c, centre in enumerate(rng.normal(size=(7, 6))):
        rows += [(len(rows) + i, (centre * (1 + i % 3) + rng.normal(size=6) * 0.05).round(2).tolist(), [i % 2, 5][c == 0]) for i in range(40)]
    rows += [(1000 + i, rows[3][1], 7 + i % 2) for i in range(12)] + rows[:20]
    bad = [None, [float("nan")] * 6, [float("inf")] * 6, [None] * 6, [1e307] * 6]
    rows += [(2000 + 5 * i, v, 0) for i, v in enumerate(bad)] + [(None, rows[0][1], 0), (2500, rows[0][1], None)]
    rows += [(3000 + i, [float(i), 2.0, 1.0], i % 2) for i in range(25)] + [(3500 + i, [], i % 3) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in {*CLASHING, "anchor", "id", "row", "pivot", "away", "positives"} - {"label"}])
    found = rows_of(hard_negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label")))
    assert len(found) > 300 and sorted(found) == sorted(plain(rows, lambda k: k % 5 == 0))


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.random(3) * 2.0**21).tolist(), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = rows_of(hard_negatives.mine(df, F.col("vec_id") % 3 == 0, F.col("label")))
    assert max(abs(r[4]) for r in found) > 1 << 53 and sorted(found) == sorted(plain(rows, lambda k: k % 3 == 0))
    huge = [(i, [1e300 * (i + 1), 1e290], i % 2) for i in range(6)]
    assert all(r[4] == (1 << 63) - 1 for r in rows_of(hard_negatives.mine(spark.createDataFrame(huge, SCHEMA), F.lit(True), F.col("label"))))


def test_rows_of_one_key(spark):
    rows = [(5, [0.5 + i / 10, 1.0], 0) for i in range(9)] + [(6, [0.4, 0.9], 0), (7, [0.3, 0.8], 1), (7, [0.25, 0.8], 1)]
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 5, F.col("label")).collect()
    assert {(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in found} == {(5, 6, 7)}


def test_walk_of_a_tree():
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (6, 12)).astype(float)
    anchors = np.concatenate([c + rng.integers(-2, 3, (9, 12)) for c in centres])
    candidates = np.concatenate([c + rng.integers(-3, 4, (80, 12)) for c in centres])
    exact = anchors @ candidates.T
    tree = hard_negatives.spanning_tree(anchors)
    assert sorted(np.concatenate(tree[2]).tolist()) == list(range(len(anchors)))
    away = np.linalg.norm(anchors[:, None] - anchors[None], axis=2)
    total, open_rows, best = 0.0, set(range(1, len(anchors))), away[0].copy()
    while open_rows:
        at = min(open_rows, key=lambda i: best[i])  # noqa: B023
        total += best[at]
        open_rows.discard(at)
        best = np.minimum(best, away[at])
    assert abs(tree[1].sum() - total) < 1e-3
    low, high = np.percentile(exact, 97, axis=1), np.percentile(exact, 99, axis=1)
    seen = 0
    for a, some, score in hard_negatives.walked(anchors, tree, candidates, low, high, 3):
        assert (score == exact[a, some]).all()
        inside = np.flatnonzero((exact[a] >= low[a]) & (exact[a] <= high[a]))
        assert set(inside.tolist()) <= set(some.tolist())
        seen += len(some)
    assert seen < 0.7 * exact.size
    for a, some, score in hard_negatives.walked(anchors, tree, candidates, None, None, 4):
        assert sorted(score)[-4:] == sorted(exact[a])[-4:]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(hard_negatives.mine(empty, F.lit(True), F.col("label"))) == []
    alone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], SCHEMA)
    assert rows_of(hard_negatives.mine(alone, F.lit(True), F.col("label"))) == []
