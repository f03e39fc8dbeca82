"""The prefix trie against a plain trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.inputs import CLASHING, SMALL, rows_of
from voxgrain.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, turns in found.items()}


def plain_trie(turns):
    members = defaultdict(list)
    for c, path in turns.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, below = defaultdict(list), {}
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        parts = [below[p] for p in children[path]]
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        below[path] = (max(1, sum(p[0] for p in parts)), own + sum(p[1] for p in parts))
    found = set()
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(turns[c]) == len(path))
        found.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def plain_rebuilt(turns):
    found = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return found


def test_trie_query(spark):
    rows = rows_of(spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    found = rows_of(queries.op13_prefix_trie(spark, SMALL))
    assert len(found) == len(set(found)) and set(found) == plain_trie(plain_rebuilt(plain_turns(rows)))


@pytest.mark.parametrize("chunk, ids", [(1024, 4096), (2, 3)])
def test_trie_of_shared_prefixes(spark, monkeypatch, chunk, ids):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rng = random.Random(3)
    rows = []
    for c in range(-5, 60):  # few different turns, so that paths meet and part in every block of columns
        size = rng.choice([1, 2, 7, 8, 9, 16, 17, 40])
        split = rng.randrange(size + 1)
        rows += [(c, i, "user" if i % 2 else None, f"turn {i}" if i < split else rng.choice(["", "a", "bb", None])) for i in range(size)]
    rows += [(c, i, "user", "all alike") for c in range(500, 540) for i in range(16)]
    rows += [(700, None, "x", "null first"), (700, -3, "x", "then this"), (700, None, "a", "first of all"), (701, 1, "b", "tie"), (701, 1, "b", "other tie"), (701, 1, "b", "tie")]
    rows += [(None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in {*CLASHING, "conv", "id", "depth", "k1", "level", "t0", "before"}])
    found = rows_of(prefix_trie.trie(df))
    assert len(found) == len(set(found)) and set(found) == plain_trie(plain_turns(rows))


def test_heads_and_conversations_without_turns(spark):
    rows = [(c, i, "user", f"{'a' if c < 150 else 'b'}{i}") for c in (0, 1, 2, 3, 100, 101, 203, 207, 305) for i in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = plain_turns(rows)
    placed = prefix_trie.placed_turns(df)
    convs = placed.where("place = 0").select("conv")
    for heads in range(6):
        changed = prefix_trie.exchanged_heads(placed, F.col("conv") - F.col("conv") % 100, F.lit(heads), most=5)
        wanted = {c: turns.get(c - c % 100, [])[:heads] + own[heads:] for c, own in turns.items()}
        assert set(rows_of(prefix_trie.nodes(changed, convs))) == plain_trie(wanted)
    none = prefix_trie.nodes(placed.where("false"), convs)
    assert set(rows_of(none)) == plain_trie({c: [] for c in turns})


def test_a_conversation_of_any_length(spark):
    """Places of conversations that lie in many tasks, or begin and end amid one."""
    rows = [(1, i, "user", "a") for i in range(7)] + [(2, i, "user", f"t{i}") for i in range(5000)] + [(c, i, "user", f"{c}") for c in (3, 4) for i in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix_trie.placed_turns(spark.createDataFrame(rows, SCHEMA)).select("conv", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, placed)) == [(c, i) for c, n in ((1, 7), (2, 5000), (3, 90), (4, 90)) for i in range(n)]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(prefix_trie.trie(empty)) == []
    assert rows_of(prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_equal_conversations_cost_one_row(spark):
    """What ROLLUP expands is the distinct rows, however many conversations share them."""
    rows = [(c, i, "user", f"turn {i}" + "x" * 3000) for c in range(400) for i in range(3)]
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).orderBy("depth").collect()
    assert [(r["depth"], r["n_convs"], r["saved_tokens"]) for r in found] == [(0, 400, 399 * 3 * 3006), (1, 400, 399 * 3 * 3006), (2, 400, 399 * 2 * 3006), (3, 400, 399 * 3006)]
    assert found[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
