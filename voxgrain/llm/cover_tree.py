"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label are one class. For every label a cover tree with halving radii is built
from a bounded sample of classes: the points of each level lie further apart than its radius and
every sampled point within it of one of them. All classes are then assigned to their nearest leaf,
and the radius that really covers each node is measured over all of them, so the bounds hold for
every vector and not just for the sample. Neighbouring leaves are bundled up to the size of a block,
so that small leaves do not cost a comparison each; a larger leaf is a bundle of several blocks. The
tree is traversed against itself: a pair of nodes is dropped if their centres are further apart than
the threshold and both covering radii together; otherwise both are opened, unless their bundles
already meet. What is left are the pairs of bundles that can hold links, and their members are
compared, exactly and block by block.

A block pair reports, per class, how many vectors it links to, and a spanning forest of the links;
the links themselves are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import components, forest, stored

SAMPLE = 2048
"""About so many classes of all labels together shape the trees."""

RADII = (1.0, 0.5, 0.25)
"""Radii of the levels below the root, whose radius is 2: unit vectors are no further apart."""

BLOCK = 8192
"""Vectors of a block if they have up to 64 numbers; blocks of longer vectors have fewer."""

ROWS = 256
"""Vectors of one block that are compared with all of another at a time."""


@dataclass
class Node:
    label: object
    centre: np.ndarray
    children: list[int]
    leaf: int = -1
    radius: float = 0.0
    bundles: tuple[int, int] = (-1, -1)
    """First and last bundle of its leaves; children follow each other, so those between are its too."""


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest number of a row is made one first, so that no square is too large or too small."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def grow(label: object, points: np.ndarray, nodes: list[Node]) -> int:
    """Append the tree of one label's sampled unit vectors; returns the root's number."""

    def add(members: np.ndarray, centre: np.ndarray, level: int) -> int:
        number = len(nodes)
        nodes.append(Node(label, centre, []))
        if level < len(RADII) and len(members) > 1:
            rest = members
            while len(rest):
                head = rest[0]
                near = np.linalg.norm(points[rest] - points[head], axis=1) <= RADII[level]
                near[0] = True  # the head is always its own
                nodes[number].children.append(add(rest[near], points[head], level + 1))
                rest = rest[~near]
        return number

    return add(np.arange(len(points)), points[0], 0)


def bundled(nodes: list[Node], members: dict[int, int], most: dict[object, int]) -> list[int]:
    """Number the bundles of leaves and return how many blocks each has; empty leaves are in none.

    Leaves come in the order of the tree. A bundle ends with its tree and before it exceeds
    ``most`` members; a leaf that does so by itself has a bundle of as many blocks as it needs.
    """
    sizes: list[int] = []
    last = None
    for node in nodes:  # parents come before their children
        n = members.get(node.leaf, 0)
        if node.children or not n:
            continue
        if node.label != last or sizes[-1] + n > most[node.label]:
            sizes.append(0)
        sizes[-1] += n
        last = node.label
        node.bundles = (len(sizes) - 1, len(sizes) - 1)
    blocks = [1] * len(sizes)
    for node in reversed(nodes):
        inner = [nodes[c].bundles for c in node.children if nodes[c].bundles[0] >= 0]
        if inner:
            node.bundles = (min(b[0] for b in inner), max(b[1] for b in inner))
        elif node.bundles[0] >= 0:
            blocks[node.bundles[0]] = -(-sizes[node.bundles[0]] // most[node.label])
    return blocks


def surviving(nodes: list[Node], roots: list[int], reach: float) -> set[tuple[int, int]]:
    """Bundle pairs (a <= b) that the covering radii do not rule out."""
    found: set[tuple[int, int]] = set()
    open_pairs = [(r, r) for r in roots if nodes[r].bundles[0] >= 0]
    while open_pairs:
        i, j = open_pairs.pop()
        mine = [x for x in nodes[i].children or [i] if nodes[x].bundles[0] >= 0]
        theirs = mine if i == j else [x for x in nodes[j].children or [j] if nodes[x].bundles[0] >= 0]
        p, q = (np.array([nodes[x].centre for x in side]) for side in (mine, theirs))
        radii = [np.array([nodes[x].radius for x in side]) for side in (mine, theirs)]
        away = np.sqrt(np.maximum(0.0, 2 - 2 * p @ q.T))  # centres are unit vectors
        near = away <= reach + radii[0][:, None] + radii[1]
        x, y = np.nonzero(np.triu(near) if i == j else near)
        (a, b), (c, d) = (np.array([nodes[x].bundles for x in side]).T for side in (mine, theirs))
        ends = [np.array([not nodes[x].children for x in side]) for side in (mine, theirs)]
        done = (a[x] == b[x]) & (c[y] == d[y]) & ((a[x] == c[y]) | ends[0][x] & ends[1][y])
        met = np.unique(np.sort(np.stack([a[x[done]], c[y[done]]], axis=1), axis=1), axis=0)
        found.update(map(tuple, met.tolist()))
        for x, y in zip(x[~done].tolist(), y[~done].tolist()):
            (a0, b0), (c0, d0) = nodes[mine[x]].bundles, nodes[theirs[y]].bundles
            if a0 != b0 or c0 != d0 or (min(a0, c0), max(a0, c0)) not in found:
                open_pairs.append((mine[x], theirs[y]))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def linkable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vector) of the rows that can have links: all present, finite and not zero.

    Vectors of different lengths are kept apart like those of different labels.
    """
    return vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & _usable(F.col(vector))).select(
        F.col(key).alias("id"), F.struct(F.col(label).alias("label"), F.size(vector).alias("size")).alias("tree"), F.col(vector).alias("v")
    )


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, n_links, component, kept): per row the vectors linked to it, and the smallest key reachable.

    Rows of one label with a cosine of at least ``threshold``, in double precision, are linked;
    equal vectors are linked to each other. Rows whose vector is null, zero or not finite, or whose
    label or key is null, have no links and are components of their own. Keys name vectors: rows of
    one key are taken as links to each other only through their vectors, but share a component.
    Only the three columns are read. An empty table gives no rows. The driver holds the sample, one
    vector more per label, and the pairs of bundles.
    """
    spark = vectors.sparkSession
    valid = linkable(vectors, key, vector, label)
    classes = stored(
        valid.groupBy("tree", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("draw", F.shiftrightunsigned(F.xxhash64("rep", "tree"), 11) / float(1 << 53)), "classes"
    )
    total = classes.count()
    sample = classes.where(F.col("draw") < SAMPLE / max(1, total)).union(
        classes.join(classes.groupBy("tree").agg(F.min("rep").alias("rep")), ["tree", "rep"], "left_semi").select(classes.columns)
    ).select(F.to_json("tree").alias("tree"), "v", "rep").dropDuplicates().orderBy("tree", "rep").toArrow()
    nodes: list[Node] = []
    roots: list[int] = []
    trees: dict[str, list[int]] = {}
    for i, name in enumerate(sample.column("tree").to_pylist()):
        trees.setdefault(name, []).append(i)
    for name, rows in trees.items():
        roots.append(grow(name, unit(_matrix(sample.column("v").take(rows))), nodes))
    leaves = [i for i, node in enumerate(nodes) if not node.children]
    for number, i in enumerate(leaves):
        nodes[i].leaf = number
    centres = {name: ([], []) for name in trees}
    for i in leaves:
        centres[nodes[i].label][0].append(nodes[i].leaf)
        centres[nodes[i].label][1].append(nodes[i].centre)
    index = {name: (np.array(a), np.array(c)) for name, (a, c) in centres.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = np.array(batch.column(0).to_pylist())
            leaf, away = np.zeros(len(trees), np.int64), np.zeros(len(trees))
            for name in np.unique(trees):
                rows = np.flatnonzero(trees == name)
                for part in np.array_split(rows, len(rows) // 2048 + 1):
                    x = unit(_matrix(batch.column(1).take(pa.array(part))))
                    own, points = index[name]
                    best = (x @ points.T).argmax(axis=1)
                    leaf[part], away[part] = own[best], np.linalg.norm(x - points[best], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1), pa.array(leaf), pa.array(away)], names=["rep", "n", "v", "leaf", "away"])

    schema = T.StructType([classes.schema["rep"], classes.schema["n"], classes.schema["v"], T.StructField("leaf", T.LongType()), T.StructField("away", T.DoubleType())])
    placed = stored(classes.select(F.to_json("tree").alias("tree"), "v", "rep", "n").mapInArrow(assign, schema), "leaves")
    # One row per leaf, of which the sample bounds the number.
    measured = {row["leaf"]: row for row in placed.groupBy("leaf").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect()}
    for i in reversed(range(len(nodes))):  # children come after their parents
        node = nodes[i]
        if node.children:
            node.radius = max(np.linalg.norm(node.centre - nodes[c].centre) + nodes[c].radius for c in node.children)
        elif node.leaf in measured:
            node.radius = measured[node.leaf]["away"] + 1e-9
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    most = {nodes[r].label: max(1, BLOCK * 64 // max(64, len(nodes[r].centre))) for r in roots}
    blocks = bundled(nodes, {leaf: row["n"] for leaf, row in measured.items()}, most)
    homes = [(nodes[i].leaf, nodes[i].bundles[0], blocks[nodes[i].bundles[0]]) for i in leaves if nodes[i].bundles[0] >= 0]
    pairs = np.array(sorted(surviving(nodes, roots, reach)), np.int64).reshape(-1, 2)
    apart = pairs[pairs[:, 0] != pairs[:, 1]]
    to = np.concatenate([pairs, apart[:, ::-1]])
    # Both tables are bounded by the sample; their sizes do not follow the vectors.
    home = spark.createDataFrame(homes, "leaf long, bundle long, own long")
    partners = spark.createDataFrame(pa.table({
        "bundle": pa.array(to[:, 0]), "other": pa.array(to[:, 1]), "others": pa.array(np.array(blocks, np.int64)[to[:, 1]]),
        "low": pa.array(np.arange(len(to)) < len(pairs)),
    }))
    # A class goes to every block pair that has its block; a pair is named by its lower bundle and block first.
    sent = placed.join(F.broadcast(home), "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), "own")).join(partners, "bundle").select(
        "rep", "n", "v", "bundle", "other", "low", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other_block")
    )
    first = F.when(F.col("bundle") == F.col("other"), F.col("block") <= F.col("other_block")).otherwise(F.col("low"))
    mine, theirs = F.struct(F.col("bundle").alias("l"), F.col("block").alias("b")), F.struct(F.col("other").alias("l"), F.col("other_block").alias("b"))
    grouped = sent.select(
        F.when(first, mine).otherwise(theirs).alias("x"), F.when(first, theirs).otherwise(mine).alias("y"), first.alias("first"), "rep", "n", "v"
    )

    def compare(group: pa.Table) -> pa.Table:
        low = group.column("first").to_numpy()
        rep, n, v = group.column("rep").to_numpy(), group.column("n").to_numpy(), unit(_matrix(group.column("v")))
        same = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        a = np.arange(len(rep)) if same else np.flatnonzero(low)
        b = a if same else np.flatnonzero(~low)
        links = np.zeros(len(rep), np.int64)
        heads, tails = [rep[:0]], [rep[:0]]
        other_side = np.ascontiguousarray(v[b].T)
        for start in range(0, len(a), ROWS):
            i, j = np.nonzero(v[a[start:start + ROWS]] @ other_side >= threshold)
            i, j = a[start + i], b[j]
            i, j = i[i != j], j[i != j]
            np.add.at(links, i, n[j])
            if not same:
                np.add.at(links, j, n[i])
            if len(i):
                node, other = forest(rep[i], rep[j])
                heads.append(node)
                tails.append(other)
        node, other = forest(np.concatenate(heads), np.concatenate(tails))
        some = np.flatnonzero(links)
        return pa.table({
            "rep": pa.array(np.concatenate([rep[some], node])), "links": pa.array(np.concatenate([links[some], np.zeros(len(node), np.int64)])),
            "other": pa.array(np.concatenate([rep[some], other])),
        })

    id_type = valid.schema["id"].dataType
    out = T.StructType([T.StructField("rep", id_type), T.StructField("links", T.LongType()), T.StructField("other", id_type)])
    found = stored(grouped.groupBy("x", "y").applyInArrow(compare, out), "links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("rep") != F.col("other")), "rep", "other")
    known = classes.join(counted, "rep", "left").join(joined, classes["rep"] == joined["node"], "left").select(
        "tree", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    rows = vectors.select(F.col(key).alias("id"), F.struct(F.col(label).alias("label"), F.size(vector).alias("size")).alias("tree"), F.col(vector).alias("v"))
    named = valid.join(known, ["tree", "v"]).select("id", "links", "component")
    fine = rows.where(F.col("id").isNull() | F.col("tree.label").isNull() | ~_usable(F.col("v")))
    alone = fine.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return named.union(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _usable(values: Column) -> Column:
    fine = values.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(values, lambda x: x != 0), F.lit(False))
