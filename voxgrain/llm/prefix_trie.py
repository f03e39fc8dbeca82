"""The prefix trie of conversations, by ROLLUP over columns of turn identities.

A turn's identity is the digest of its role and text, followed by the length of the text. The turns
of a conversation are laid out as columns, WIDTH of them to a row; a longer conversation goes on in
further rows, and each row names the node that its block of columns starts from. One ROLLUP over the
columns then groups by all prefixes of all blocks at once, and grouping_id tells their depths. Equal
rows are counted before they are rolled up, so thousands of equal conversations cost one row.

A node is known by its depth and a 128-bit key: the exclusive or of a hash of each (place, turn)
on its path. Such keys can be had for any prefix from running totals, without walking the path.

Sums over subtrees are sums over members. A node belongs to its smallest member, so each conversation
owns the lower end of its path; the leaves below a node are the leaves its members own, and the texts
below it are the texts that its members own there. A second ROLLUP adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from voxgrain.llm.common import stored

WIDTH = 8
"""Turns in a row of columns."""

CHUNK = 1024
"""Rows of one conversation whose running totals are made in one go; totals of chunks come first."""

IDS = 4096
"""Conversation numbers that share a slice of a node's list of members."""

TURNS = [f"t{i}" for i in range(WIDTH)]
KEY = ["k1", "k2"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task with their number within conversation and task."""
    part = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        local = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
        if conv[0] == last:
            local[:starts[1] if len(starts) > 1 else len(conv)] += count
        last, count = conv[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.full(len(conv), part)), pa.array(local)], names=["conv", "id", "part", "local"]
        )


def placed_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, id): every turn's identity and its place in its conversation, from 0.

    Turns come by number, null first; those of one number by role and the digest of their text.
    Null roles and texts are empty. Rows without a conversation number are left out. The rows are
    sorted as a whole and numbered task by task, so a conversation may have any length: only the first
    conversation of a task can have begun in tasks before it, and the driver adds up what these hold,
    one row per task.
    """
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of))
    narrow = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), role_of.alias("role"),
        F.concat(digest, F.length(text_of).cast("string")).alias("id"),
    )
    ordered = narrow.orderBy("conv", F.asc_nulls_first("turn"), "role", "id").select("conv", "id")
    rows = stored(ordered.mapInArrow(_numbered, "conv long, id string, part long, local long"), "turns")
    ends = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "local")).alias("last")).orderBy("part").collect()
    bases, open_conv, before = [], None, 0
    for r in ends:
        carried = before if r["first"] == open_conv else 0
        if carried:
            bases.append((r["part"], r["first"], carried))
        whole = r["first"] == r["last"]["conv"]
        open_conv, before = r["last"]["conv"], r["last"]["local"] + 1 + (carried if whole else 0)
    base = conversations.sparkSession.createDataFrame(bases, "part long, first long, base long")
    return rows.join(F.broadcast(base), "part", "left").select(
        "conv", (F.col("local") + F.when(F.col("conv") == F.col("first"), F.col("base")).otherwise(0)).alias("place"), "id"
    )


def exchanged_heads(placed: DataFrame, donor: Column, heads: Column, most: int) -> DataFrame:
    """``placed`` with the first ``heads`` turns of each conversation replaced by those of another.

    ``donor`` and ``heads`` (at most ``most``) are expressions over the column ``conv``. A donor with
    fewer turns gives all, one that does not exist gives none; what follows moves up.
    """
    given = placed.where(F.col("place") < most).groupBy(F.col("conv").alias("donor")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda t: t["id"]).alias("given")
    )
    # Every conversation has a turn at place 0.
    asked = placed.where("place = 0").select("conv", donor.alias("donor"), heads.alias("heads"))
    changes = asked.join(given, "donor", "left").select(
        "conv", F.coalesce(F.slice("given", F.lit(1), F.col("heads").cast("int")), F.array().cast("array<string>")).alias("taken")
    )
    changes = stored(changes, "heads")
    taken = changes.select("conv", F.posexplode("taken").alias("place", "id")).select("conv", F.col("place").cast("long").alias("place"), "id")
    own = placed.where(F.col("place") >= heads)
    kept = own.join(changes, "conv").select("conv", (F.col("place") - heads + F.size("taken")).alias("place"), "id")
    return kept.union(taken)


def _length(turn: Column) -> Column:
    """Characters of the text of a turn, from its identity; none where there is no turn."""
    return F.coalesce(F.substring(turn, 33, 20).cast("long"), F.lit(0).cast("long"))


def _folded(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def _hashes(block: Column, i: int) -> list[Column]:
    """Both hashes of the turn in column ``i``; zero where there is none."""
    turn, place = F.col(TURNS[i]), block * WIDTH + i
    zero = F.lit(0).cast("long")
    return [F.when(turn.isNull(), zero).otherwise(h) for h in (F.xxhash64(place, turn), F.xxhash64(turn, place, F.lit(1)))]


def blocks(placed: DataFrame) -> DataFrame:
    """(conv, block, k1, k2, before, own1, own2, chars, size, t0 ...): rows of WIDTH turns.

    ``k1`` and ``k2`` are the key of the node the row starts from and ``before`` the characters on
    the way to it; ``own1``, ``own2``, ``chars`` and ``size`` are of the row itself.
    """
    turns = placed.select("conv", F.expr(f"place div {WIDTH * CHUNK}").alias("chunk"), "place", "id").repartition("conv", "chunk")
    rows = turns.groupBy("conv", "chunk", F.expr(f"place div {WIDTH}").alias("block")).agg(
        *[F.max(F.when(F.col("place") % WIDTH == i, F.col("id"))).alias(t) for i, t in enumerate(TURNS)]
    )
    parts = [_hashes(F.col("block"), i) for i in range(WIDTH)]
    rows = rows.select(
        "conv", "chunk", "block", _folded([p[0] for p in parts]).alias("own1"), _folded([p[1] for p in parts]).alias("own2"),
        sum((_length(F.col(t)) for t in TURNS), F.lit(0).cast("long")).alias("chars"),
        sum((F.col(t).isNotNull().cast("long") for t in TURNS), F.lit(0).cast("long")).alias("size"), *TURNS,
    )
    zero = F.lit(0).cast("long")
    totals = {"own1": F.bit_xor, "own2": F.bit_xor, "chars": F.sum}
    chunks = rows.groupBy("conv", "chunk").agg(*[f(c).alias(c) for c, f in totals.items()])
    before = W.Window.partitionBy("conv").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = chunks.select("conv", "chunk", *[F.coalesce(f(c).over(before), zero).alias(f"base_{c}") for c, f in totals.items()])
    before = W.Window.partitionBy("conv", "chunk").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    within = [F.coalesce(f(c).over(before), zero).alias(f"in_{c}") for c, f in totals.items()]
    joined = rows.select("*", *within).join(bases, ["conv", "chunk"])
    return joined.select(
        "conv", "block", F.col("base_own1").bitwiseXOR(F.col("in_own1")).alias("k1"), F.col("base_own2").bitwiseXOR(F.col("in_own2")).alias("k2"),
        (F.col("base_chars") + F.col("in_chars")).alias("before"), "own1", "own2", "chars", "size", *TURNS,
    )


def _rolled(rows: DataFrame, **measures: str) -> DataFrame:
    """One row per node below the root, by ROLLUP: depth, key, parent's key, length of its text and of the path above it, and ``measures``."""
    first, listed = ["block", *KEY, "before"], ", ".join(f"{m} AS {name}" for name, m in measures.items())
    found = rows.sparkSession.sql(
        f"""SELECT {", ".join(first + TURNS)}, {WIDTH} - bit_count(grouping_id()) AS level, {listed}
        FROM {{rows}} GROUP BY {", ".join(first)}, ROLLUP ({", ".join(TURNS)})""", rows=rows,
    ).where("level > 0")
    # Prefixes longer than their conversations end in a column without a turn.
    whole = [F.col(t).isNotNull() | (F.col("level") <= i) for i, t in enumerate(TURNS)]
    found = found.where(reduce(lambda a, b: a & b, whole))
    parts = [_hashes(F.col("block"), i) for i in range(WIDTH)]
    inside = [F.col("level") > i + 1 for i in range(WIDTH)]
    zero = F.lit(0).cast("long")
    above = lambda values: [F.when(inside[i], v).otherwise(zero) for i, v in enumerate(values)]
    last = F.coalesce(*[F.col(t) for t in reversed(TURNS)])
    keys = [_folded([F.col(k), *[p[n] for p in parts]]).alias(f"node{n + 1}") for n, k in enumerate(KEY)]
    parents = [_folded([F.col(k), *above([p[n] for p in parts])]).alias(f"parent{n + 1}") for n, k in enumerate(KEY)]
    path = F.col("before") + sum(above([_length(F.col(t)) for t in TURNS]), zero)
    names = [c for c in found.columns if c not in first + TURNS + ["level"]]
    return found.select(
        (F.col("block") * WIDTH + F.col("level")).alias("depth"), *keys, *parents, _length(last).alias("chars"), path.alias("path"), *names
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, node1, node2, sha256) of the decimal numbers of the conversations that end at each node, ascending.

    The numbers of a node are joined in slices of IDS and then streamed in order, so no list is held whole.
    """
    by = ["depth", "node1", "node2"]
    slices = ends.groupBy(*by, F.floor(F.col("conv") / IDS).alias("slice")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = slices.repartition(*by).sortWithinPartitions(*by, "slice").select(*by, "ids")
    schema = T.StructType([*[ordered.schema[c] for c in by], T.StructField("sha256", T.StringType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=schema.names)

        for batch in batches:
            for *node, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if node != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
        if at:
            done.append((*at, digest.hexdigest()))
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(stream, schema)


def nodes(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``placed`` has the turns (conv, place, id) and ``convs`` the numbers of all conversations, each
    once, those without turns too. No conversations give no nodes.
    """
    rows = stored(blocks(placed), "rows")
    start = ["block", "k1", "k2", "before", *TURNS]
    zero = F.lit(0).cast("long")
    distinct = rows.groupBy(*start).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
    found = stored(_rolled(distinct, conv="min(conv)", n="sum(n)"), "nodes")
    # One row per node with its smallest member and its children; the root is only its children's parent.
    known = ["depth", "node1", "node2"]
    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent1").alias("node1"), F.col("parent2").alias("node2")]
    each = found.select(*known, "conv", "chars", zero.alias("child"))
    each = each.union(found.select(*parent, F.lit(None).cast("long"), zero, F.lit(1).cast("long")))
    tree = stored(each.groupBy(*known).agg(F.max("conv").alias("conv"), F.max("chars").alias("chars"), F.sum("child").alias("n_children")), "tree")
    # Per conversation: its end, its characters, those of the nodes it owns, and whether it owns a leaf.
    sums, own = ["depth", "total", "owned", "leaf"], F.struct("conv", "owned", "total")
    parts = convs.select("conv", *[zero.alias(c) for c in ("depth", "node1", "node2", "total", "owned", "leaf")])
    parts = parts.union(rows.select("conv", "size", "own1", "own2", "chars", zero, zero))
    owned = tree.where("conv IS NOT NULL")
    parts = parts.union(owned.select("conv", zero, zero, zero, zero, "chars", (F.col("n_children") == 0).cast("long")))
    members = stored(parts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in sums], *[F.bit_xor(k).alias(k) for k in known[1:]]), "members")
    weighed = rows.select("conv", *start).join(members.select("conv", *sums[1:]), "conv")
    below = weighed.groupBy(*start).agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums[1:]])
    every = _rolled(below, own="min(own)", n="sum(n)", **{c: f"sum({c})" for c in sums[1:]})
    # The root has no columns to be grouped by.
    root = members.agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums[1:]]).where("n > 0")
    every = every.unionByName(root.select(*[zero.alias(c) for c in every.columns if c not in root.columns], "*"))
    # All members' texts from here on, less those of the nodes below, each counted once.
    again = F.col("total") - F.col("n") * F.col("path")
    once = F.col("owned") - F.col("own.owned") + F.col("own.total") - F.col("path")
    above = tree.select(F.col("depth").alias("up"), F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("conv").alias("parent"))
    ends = _digests(members.select("conv", *known))
    joined = every.withColumn("up", F.col("depth") - 1).join(above, ["up", "parent1", "parent2"], "left")
    joined = joined.join(tree.select(*known, "n_children"), known, "left").join(ends, known, "left")
    smallest = root.select("own.conv").scalar()
    children = F.coalesce("n_children", zero)
    return joined.select(
        F.col("own.conv").alias("conv_id"), "depth", F.when(F.col("up") == 0, smallest).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), children.alias("n_children"), F.when(children == 0, F.lit(1).cast("long")).otherwise(F.col("leaf")).alias("n_leaves"),
        (again - once).alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the prefix trie of ``conversations``, one row per distinct first d turns, root included.

    Two turns are equal if role and text are. ``conv_id`` is a node's smallest member, which with
    ``depth`` names it. Nulls and ties are as in ``placed_turns``; repeated rows are repeated turns.
    Other columns are not read, whatever their names. Very long texts are read once, for their
    digest. Empty tables have no nodes.
    """
    placed = placed_turns(conversations, key, turn, role, text)
    return nodes(placed, placed.where("place = 0").select("conv"))
