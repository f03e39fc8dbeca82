"""Hard negatives: per anchor and positive the best rows of other labels that score within a window.

Vectors are rounded to whole numbers, so scores are exact. Anchors are sorted to a bounded number of
pivots, which are anchors themselves, and cut into blocks of neighbouring anchors. The pivots are the
upper level of the spanning tree and each block's minimum spanning tree is the lower one. Along an
edge a score changes by no more than the edge's length times the candidate's norm:

- at a pivot, the bound over all anchors sorted to it tells which candidates no window of theirs can
  hold; these are not sent to its blocks;
- inside a block the tree is walked from its root. A child's bounds come from its parent's, and only
  candidates whose bounds overlap a window of the child are scored again. The others keep their
  bounds, widened by the edge, for the grandchildren.

Positives are found in the same way among rows of the anchor's label; their window is open above and
begins at the last place that lower bounds already secure. Every anchor meets every candidate that
its bounds do not rule out, so results are exact. Candidates come in blocks too: a group of one label
or around one pivot is many pairs of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from voxgrain.llm.common import stored

PIVOTS = 256
"""At most so many anchors are the upper level of the tree; they and their bounds are sent to all tasks."""

ANCHORS = 512
"""About so many anchors in a block."""

CANDIDATES = 32768
"""About so many candidates in a block, if they have up to 64 numbers; fewer of longer vectors."""

CHUNK = 4096
"""Candidates of a block that are bounded at a time."""

DENSE = 0.2
"""Where more than this share overlaps, all candidates are scored in one product."""

EXACT = float(1 << 52)
LONG = (-(1 << 63), (1 << 63) - 1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Norms, a little too large; whatever does not fit is infinite and rules nothing out."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * (1 + 1e-9)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision where that is enough, else as Python's."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[-1])
    if most < EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def _floats(values: np.ndarray) -> np.ndarray:
    """Scores as doubles; infinite beyond them."""
    if values.dtype != object:
        return values
    near = lambda x: float(x) if abs(x) < 1 << 1000 else np.inf if x > 0 else -np.inf
    return np.array([near(x) for x in values.ravel()], np.float64).reshape(values.shape)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(parent, edge length, places by level) of a minimum spanning tree over the rows of ``points``; the root is row 0."""
    n = len(points)
    parent, edge, depth = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    open_rows = np.ones(n, bool)
    at, edge[0] = 0, 0.0
    for step in range(n):
        if step:
            rest = np.flatnonzero(open_rows)
            at = int(rest[edge[rest].argmin()])
            depth[at] = depth[parent[at]] + 1
        open_rows[at] = False
        away = _norms(points - points[at])
        nearer = open_rows & (away < edge)
        parent[nearer], edge[nearer] = at, away[nearer]
    return parent, edge, [np.flatnonzero(depth == d) for d in range(depth.max(initial=0) + 1)]


def walked(
    anchors: np.ndarray, tree: tuple, candidates: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, wanted: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidate places, scores) for all candidates whose bounds overlap the anchor's window.

    The window is ``low`` to ``high``. Without ``low`` it begins at the ``wanted``-th largest lower
    bound, so that the ``wanted`` best are in it.
    """
    parent, edge, levels = tree
    norms = _norms(candidates)
    shape = (len(anchors), len(candidates))
    below, above = np.empty(shape), np.empty(shape)
    for number, level in enumerate(levels):
        near = np.ones((len(level), len(candidates)), bool)
        if number:
            with np.errstate(invalid="ignore", over="ignore"):
                reach = edge[level][:, None] * norms
                under, over = below[parent[level]] - reach, above[parent[level]] + reach
                slack = 1e-9 * (np.abs(under) + np.abs(over)) + 1e-6
                if low is None:
                    kth = min(wanted, len(candidates))
                    least = -np.partition(-np.nan_to_num(under, nan=-np.inf), kth - 1, axis=1)[:, kth - 1:kth]
                    near = ~(over + slack < least - slack.max(axis=1, keepdims=True))
                else:
                    near = ~((over + slack < low[level][:, None]) | (under - slack > high[level][:, None]))
            below[level], above[level] = under, over
        if near.mean() > DENSE:
            got = scores(anchors[level], candidates)
            below[level] = above[level] = _floats(got)
            for row, place in enumerate(level):
                yield int(place), np.arange(len(candidates)), got[row]
        else:
            for row, place in enumerate(level):
                some = np.flatnonzero(near[row])
                got = scores(anchors[place:place + 1], candidates[some])[0]
                below[place, some] = above[place, some] = _floats(got)
                yield int(place), some, got


def rounded(vectors: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, scale: int) -> DataFrame:
    """(id, row, label, size, v, anchor) of the rows that take part, each once.

    These have a key, a label and a vector whose numbers are all present, finite and finite times
    ``scale``. ``row`` tells rows of one key apart.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * float(scale))
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(usable, F.lit(False))
    found = vectors.where(fine).select(F.col(key).cast("long").alias("id"), label.alias("label"), scaled.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    # A double beyond 2**52 is a whole number as it is.
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    found = found.select("id", "label", F.size("v").cast("long").alias("size"), whole.alias("v"), "anchor")
    return found.groupBy("id", F.xxhash64("id", "label", "v").alias("row")).agg(*[F.first(c).alias(c) for c in ("label", "size", "v")], F.max("anchor").alias("anchor"))


def _share(row: str) -> Column:
    """A number in [0, 1) by the row."""
    return F.shiftrightunsigned(F.xxhash64(F.col(row), F.lit(7)), 11) / float(1 << 53)


def _located(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Add ``block``: about ``most`` rows each, neighbouring pivots together, numbered from 0 within ``by``.

    A group has as many rows here as it has pivots, which are bounded.
    """
    sizes = rows.groupBy(*by, "pivot").agg(F.count(F.lit(1)).alias("n"))
    group = W.Window.partitionBy(*by)
    earlier = group.orderBy("pivot").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "pivot", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(group).alias("all"))
    rows = rows.join(starts, [*by, "pivot"])
    blocks = F.ceil(F.col("all") / most)
    place = (F.col("before") + _share("row") * F.col("n")) / F.col("all")
    return rows.withColumn("block", F.least(F.floor(place * blocks), blocks - 1).cast("long")).drop("n", "before", "all")


class Pivots:
    """The upper level of the tree, per length of vectors: chosen anchors and what is sorted to them."""

    def __init__(self, sample: pa.Table):
        self.points: dict[int, np.ndarray] = {}
        sizes = np.array(sample.column("size").to_pylist(), np.int64)
        for size in np.unique(sizes).tolist():
            self.points[size] = _matrix(sample.column("v").take(pa.array(np.flatnonzero(sizes == size))))

    def nearest(self, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each row; pivot 0 at any distance where there is none of this length."""
        points = self.points.get(size)
        if points is None:
            return np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            away = np.einsum("ij,ij->i", points, points) - 2 * rows @ points.T
        best = np.nan_to_num(away, nan=np.inf).argmin(axis=1)
        return best, _norms(rows - points[best])


def _by_size(batch: pa.RecordBatch, size: str, v: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
    for one in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == one)
        yield one, places, _matrix(batch.column(batch.schema.get_field_index(v)).take(pa.array(places)))


def _sorted_to_pivots(anchors: DataFrame, pivots: Pivots) -> DataFrame:
    schema = T.StructType([*anchors.schema, T.StructField("pivot", T.LongType()), T.StructField("away", T.DoubleType())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for size, places, rows in _by_size(batch, "size", "v"):
                pivot[places], away[places] = pivots.nearest(size, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names=schema.names)

    return anchors.mapInArrow(sort, schema)


def _wanted_blocks(pivots: Pivots, reach: dict, norms: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the anchor blocks that may hold a window it falls in; ``reach`` has rows (pivot, away, low, high, first, last)."""
    known = reach.get(size)
    if known is None:
        return [np.zeros(0, np.int64)] * len(rows)
    points = pivots.points.get(size)
    near = np.ones((len(rows), len(known)), bool)
    if points is not None:
        pivot, away, low, high = (np.array([k[i] for k in known]) for i in range(4))
        with np.errstate(invalid="ignore", over="ignore"):
            score = rows @ points[pivot.astype(np.int64)].T
            slack = norms[:, None] * away * (1 + 1e-9) + 1e-9 * np.abs(score) + 1e-6
            near = ~((score + slack < low) | (score - slack > high))
    spans = [np.arange(k[4], k[5] + 1) for k in known]
    chosen: dict[bytes, np.ndarray] = {}
    for row in near:
        if row.tobytes() not in chosen:
            chosen[row.tobytes()] = np.unique(np.concatenate([np.zeros(0, np.int64), *[spans[i] for i in np.flatnonzero(row)]]))
    return [chosen[row.tobytes()] for row in near]


def _sent(rows: DataFrame, pivots: Pivots, reach: dict) -> DataFrame:
    """Candidates, once per anchor block that the pivots do not rule out, as ``block``."""
    schema = T.StructType([*rows.schema, T.StructField("blocks", T.ArrayType(T.LongType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for size, places, vectors in _by_size(batch, "size", "v"):
                for place, blocks in zip(places.tolist(), _wanted_blocks(pivots, reach, _norms(vectors), vectors, size)):
                    chosen[place] = blocks
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(choose, schema).withColumn("block", F.explode("blocks")).drop("blocks")


def _paired(anchors: DataFrame, candidates: DataFrame, by: list[str], cuts: DataFrame) -> DataFrame:
    """Rows of both sides under the pair (block, part): anchors go to all parts of candidates, ``first`` marks them."""
    spread = anchors.join(cuts, by).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").withColumn("first", F.lit(True))
    dealt = candidates.join(cuts, by).withColumn("part", F.floor(_share("row") * F.col("parts")).cast("long")).drop("parts").withColumn("first", F.lit(False))
    return spread.unionByName(dealt, allowMissingColumns=True)


def _split(group: pa.Table) -> tuple[dict, dict]:
    first = group.column("first").to_numpy()
    sides = []
    for mask in (first, ~first):
        part = group.filter(pa.array(mask))
        sides.append({"id": part.column("id").to_numpy(), "row": part.column("row").to_numpy(), "table": part, "v": _matrix(part.column("v")) if part.num_rows else None})
    return sides[0], sides[1]


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by higher score, then smaller id, then row."""
    return np.lexsort((rows, ids, -score)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i], rows[i])), np.int64)


def _long(values) -> pa.Array:
    return pa.array([max(LONG[0], min(LONG[1], int(x))) for x in values], pa.int64())


def _positives(wanted: int):
    def search(group: pa.Table) -> pa.Table:
        mine, theirs = _split(group)
        kept = []
        if mine["v"] is not None and theirs["v"] is not None:
            tree = spanning_tree(mine["v"])
            # The rows of an anchor's own key may be among the best, and do not count.
            own = theirs["id"][np.isin(theirs["id"], mine["id"])]
            more = int(np.unique(own, return_counts=True)[1].max(initial=0))
            for start in range(0, len(theirs["id"]), CHUNK):
                part = slice(start, start + CHUNK)
                for a, some, score in walked(mine["v"], tree, theirs["v"][part], None, None, wanted + more):
                    places = some + start
                    other = theirs["id"][places] != mine["id"][a]
                    places, score = places[other], score[other]
                    if len(places) > wanted and score.dtype != object:
                        least = -np.partition(-score, wanted - 1)[wanted - 1]
                        places, score = places[score >= least], score[score >= least]
                    order = _best(score, theirs["id"][places], theirs["row"][places])[:wanted]
                    kept += [(a, int(places[o]), score[o]) for o in order]
        return pa.table({
            "anchor": pa.array([int(mine["id"][a]) for a, _, _ in kept], pa.int64()), "anchor_row": pa.array([int(mine["row"][a]) for a, _, _ in kept], pa.int64()),
            "positive": pa.array([int(theirs["id"][p]) for _, p, _ in kept], pa.int64()), "positive_row": pa.array([int(theirs["row"][p]) for _, p, _ in kept], pa.int64()),
            "score": _long(s for _, _, s in kept),
        })

    return search


def _negatives(wanted: int, low: int, high: int):
    def search(group: pa.Table) -> pa.Table:
        mine, theirs = _split(group)
        kept = []
        if mine["v"] is not None and theirs["v"] is not None:
            positives = [[(p["place"], p["score"]) for p in row] for row in mine["table"].column("positives").to_pylist()]
            windows = [[(-(-low * s // 100), high * s // 100) for _, s in row] for row in positives]
            least = np.array([min(w[0] for w in row) for row in windows], np.float64)
            most = np.array([max(w[1] for w in row) for row in windows], np.float64)
            labels = pa.concat_arrays([*mine["table"].column("label").chunks, *theirs["table"].column("label").chunks])
            codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            own, others = codes[:len(mine["id"])], codes[len(mine["id"]):]
            tree = spanning_tree(mine["v"])
            for start in range(0, len(theirs["id"]), CHUNK):
                part = slice(start, start + CHUNK)
                for a, some, score in walked(mine["v"], tree, theirs["v"][part], least, most, wanted):
                    places = some + start
                    bottom, top = min(w[0] for w in windows[a]), max(w[1] for w in windows[a])
                    fits = (others[places] != own[a]) & np.asarray((score >= bottom) & (score <= top), bool)
                    if not fits.any():
                        continue
                    places, score = places[fits], score[fits]
                    order = _best(score, theirs["id"][places], theirs["row"][places])
                    places, score = places[order], score[order]
                    for (place, _), (bottom, top) in zip(positives[a], windows[a]):
                        begin = int(np.asarray(score > top, bool).sum())
                        for o in range(begin, min(begin + wanted, len(score))):
                            if score[o] < bottom:
                                break
                            kept.append((a, place, int(places[o]), score[o]))
        return pa.table({
            "anchor": pa.array([int(mine["id"][k[0]]) for k in kept], pa.int64()), "anchor_row": pa.array([int(mine["row"][k[0]]) for k in kept], pa.int64()),
            "place": pa.array([k[1] for k in kept], pa.int32()), "negative": pa.array([int(theirs["id"][k[2]]) for k in kept], pa.int64()),
            "negative_row": pa.array([int(theirs["row"][k[2]]) for k in kept], pa.int64()), "negative_score": _long(k[3] for k in kept),
        })

    return search


def _parts(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts): how many blocks the candidates of a group are cut into."""
    most = F.greatest(F.lit(1), F.floor(F.lit(CANDIDATES * 64) / F.greatest(F.lit(64), F.col("size"))))
    return counted.select(*by, F.ceil(F.col("n") / most).cast("long").alias("parts"))


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A number x counts as floor(``scale`` * x); a score is the inner product with the anchor, higher
    first, then smaller key. Rows for which ``is_anchor`` holds are anchors. An anchor's positives are
    its first ``positives`` other rows of equal ``label``; its negatives, for each positive, the first
    ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the
    positive's. Both expressions are over the columns of ``vectors``.

    Rows without a key, label or vector, or whose vector holds a null or a number that is not finite,
    also after scaling, take no part. Rows alike in key, label and vector count once; other rows of
    one key are further rows, but not each other's positives. Vectors of different lengths have no
    score, empty ones score 0. Scores beyond 64 bits are given as the nearest long. Only the columns
    named are read, whatever else there is. Empty tables give no rows. The driver holds at most
    PIVOTS vectors and, for each, one row of bounds.
    """
    found = stored(rounded(vectors, key, vector, label, is_anchor, scale), "rows")
    rows, anchors = found.drop("anchor"), found.where("anchor").drop("anchor")
    sample = anchors.select("size", "v", "id", "row").orderBy(F.xxhash64("id", "row"), "id", "row").limit(PIVOTS).select("size", "v").toArrow()
    pivots = Pivots(sample)
    placed = stored(_sorted_to_pivots(anchors, pivots), "anchors")

    # Positives: blocks of one label against candidates of that label.
    group = ["size", "label"]
    cuts = _parts(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), group)
    blocks = _located(placed, group, ANCHORS)
    counts = blocks.groupBy(*group).agg((F.max("block") + 1).alias("blocks"))
    sent = rows.join(counts, group).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    pairs = _paired(blocks.drop("pivot", "away"), sent, group, cuts)
    out = "anchor long, anchor_row long, positive long, positive_row long, score long"
    best = pairs.groupBy(*group, "block", "part").applyInArrow(_positives(positives), out)
    order = W.Window.partitionBy("anchor", "anchor_row").orderBy(F.desc("score"), "positive", "positive_row")
    best = stored(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    own = best.groupBy(F.col("anchor").alias("id"), F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("positives"))
    asked = placed.join(own, ["id", "row"])

    # Negatives: blocks of all labels, and for each pivot what its anchors can reach.
    blocks = stored(_located(asked, ["size"], ANCHORS), "blocks")
    window = [F.array_min(F.transform("positives", lambda p: p["score"].cast("double") * low / 100)), F.array_max(F.transform("positives", lambda p: p["score"].cast("double") * high / 100))]
    spans = blocks.groupBy("size", "pivot").agg(
        F.max("away").alias("away"), F.min(window[0]).alias("low"), F.max(window[1]).alias("high"), F.min("block").alias("first"), F.max("block").alias("last")
    ).collect()
    reach: dict[int, list] = {}
    for s in spans:
        edges = [s[side] + sign * (1 + 1e-9 * abs(s[side])) for side, sign in (("low", -1), ("high", 1))]
        reach.setdefault(s["size"], []).append((s["pivot"], s["away"], *edges, s["first"], s["last"]))
    sent = stored(_sent(rows, pivots, reach), "sent")
    by = ["size", "block"]
    cuts = _parts(sent.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    pairs = _paired(blocks.drop("pivot", "away"), sent, by, cuts)
    out = "anchor long, anchor_row long, place int, negative long, negative_row long, negative_score long"
    hits = pairs.groupBy(*by, "part").applyInArrow(_negatives(negatives, low, high), out)
    order = W.Window.partitionBy("anchor", "anchor_row", "place").orderBy(F.desc("negative_score"), "negative", "negative_row")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hits.join(best.select("anchor", "anchor_row", "place", "positive", "score"), ["anchor", "anchor_row", "place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )
