"""Near duplicates, fingerprints and vectors against all pairs compared one by one."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.inputs import MESSY, SMALL, joined, messy, no_rows, rows_of, texts_of
from voxgrain.llm import common, cover_tree, fingerprints, queries, shingle_dedup, simhash_dedup


def plain_simhash(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicate_query(spark):
    texts = texts_of(spark)
    prints = {k: plain_simhash(t) for k, t in texts.items()}
    keys = sorted(texts)
    links = [(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    component = joined(links, keys)
    found = queries.op2_simhash_dedup(spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {k: (f"{prints[k]:016x}", component[k]) for k in keys}


@pytest.mark.parametrize("most", [1 << 22, 500])
def test_links_of_planted_fingerprints(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    fps = []
    for start in rng.integers(0, 2**63, 12, dtype=np.uint64):
        value = int(start)
        for step in range(6):  # chains whose neighbours differ in 0 to 6 bits
            for bit in rng.choice(64, step, replace=False):
                value ^= 1 << int(bit)
            fps.append(value)
    fps = sorted(set(fps))
    wanted = joined([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], fps)
    sets = {frozenset(f for f in fps if wanted[f] == r) for r in set(wanted.values())}
    values = np.array(fps, np.uint64)
    monkeypatch.setattr(simhash_dedup, "MOST_VARIANTS", most)
    links = []
    for prefix in range(16):
        left = 2 - np.bitwise_count((values >> np.uint64(60)) ^ np.uint64(prefix)).astype(np.int64)
        links += list(zip(*[x.tolist() for x in common.forest(*simhash_dedup._colliding(values[left >= 0], left[left >= 0], 60))]))
    got = joined(links, fps)
    assert {frozenset(f for f in fps if got[f] == r) for r in set(got.values())} == sets


def test_near_duplicate_edges(spark):
    found = {(r["doc_id"], r["fp"], r["component"]) for r in simhash_dedup.near_duplicates(messy(spark)).collect()}
    parts = {}
    for key, _, component in found:
        parts.setdefault(component, set()).add(key)
    assert parts[1] == {1, 2} and parts[3] == {3, 4, 5} and {6, 7} <= parts[6]
    assert simhash_dedup.near_duplicates(messy(spark)).count() == len(MESSY)
    kept = simhash_dedup.keep_one(messy(spark))
    assert sorted([r["doc_id"] for r in kept.collect() if r["doc_id"]]) == [1, 3, 6, 8, 9, 10]
    assert kept.columns == messy(spark).columns
    assert rows_of(simhash_dedup.near_duplicates(no_rows(spark))) == []


def test_one_row_of_each_group_stays(spark):
    other = "Another text that shares no words with what stands above it, at all."
    rows = [(1, MESSY[0][1], "s1")] * 3 + [(2, MESSY[0][1], "s2"), (None, MESSY[0][1], "s1"), (1, other, "s1"), (None, other, "s1")]
    rows += [(None, "no key here but words", "s3")] * 2
    kept = simhash_dedup.keep_one(messy(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, MESSY[0][1]), (1, other), (None, "no key here but words")]))


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash_dedup.near_links(spark.createDataFrame([(1,), (2,)], "fp long"), radius=3)


def plain_shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_similar_texts_are_one_document(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for group in range(8):
        words = [f"w{x}" for x in rng.integers(0, 5000, 220)]
        for step in range(9):  # copies of the first with up to 12 changed words, so at about 0.57 to 1
            copy = list(words)
            for place in rng.choice(220, [0, 1, 2, 4, 5, 6, 7, 9, 12][step], replace=False):
                copy[place] = f"x{group}_{step}_{place}"
            texts[len(texts)] = " ".join(copy)
    texts |= {900: "", 901: " ", 902: "Two words", 903: "two  WORDS", 904: "two words more"}
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    links = [(a, b) for a in texts for b in texts if a < b and like(sets[a], sets[b]) >= 0.8]
    wanted = joined(links, texts)
    assert any(0.8 <= like(sets[a], sets[b]) < 0.85 for a, b in links) and len(set(wanted.values())) > 12
    df = messy(spark, [(k, t, "s1") for k, t in texts.items()])
    found = {r["doc_id"]: r["component"] for r in shingle_dedup.near_duplicates(df).collect()}
    assert found == wanted
    kept = corpus_pipeline.distinct(spark, df, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted.values()))


@pytest.mark.parametrize("size", [100, 200, 400])
def test_comparisons_follow_the_number_of_copies(spark, monkeypatch, size):
    """Copies near a common source but mostly not near each other: comparisons grow in proportion."""
    rng = np.random.default_rng(size)
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for i in range(size):
        copy = list(words)
        for place in rng.choice(150, 3 + i % 7, replace=False):
            copy[place] = f"x{i}_{place}"
        texts.append(" ".join(copy))
    compared, measured = [], shingle_dedup._measured
    monkeypatch.setattr(shingle_dedup, "_measured", lambda pairs, sets: (compared.append(pairs.count()), measured(pairs, sets))[1])
    df = messy(spark, [(i, t, "s1") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["component"] for r in shingle_dedup.near_duplicates(df).collect()}
    sets = [plain_shingles(t) for t in texts]
    links = [(a, b) for a in range(size) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert found == joined(links, range(size)) and len(set(found.values())) > size // 4
    assert sum(compared) <= 12 * size


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(500, i) for i in range(3, 90)], [(1, 2), (None, 2), (5, 4)],
])
@pytest.mark.parametrize("few", [1 << 16, 5, 0])
def test_components(spark, monkeypatch, few, edges):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    df = spark.createDataFrame(edges, "a long, b long")
    whole = [(a, b) for a, b in edges if a is not None and b is not None]
    nodes = {x for e in edges for x in e if x is not None}
    assert dict(rows_of(common.components(df, "a", "b"))) == joined(whole, nodes)


def test_fingerprint_query(spark):
    texts = texts_of(spark)
    order = sorted(texts, reverse=True)
    found = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, SMALL).collect()}
    assert len(found) == len(texts)
    for key, after in zip(order, order[1:] + order[:1]):
        text, other, row = texts[key], texts[after], found[key]
        third = len(text) // 3
        edited = text[:len(text) - third] + other[:third]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        mine, theirs, last = (fingerprints.fingerprint(t.encode()) for t in (text, edited, other))
        assert (row["fingerprint"], row["edited_fingerprint"]) == (f"{mine:016x}", f"{theirs:016x}")
        assert (row["near_edited"], row["near_next"]) == (1 - (mine ^ theirs).bit_count() / 64, 1 - (mine ^ last).bit_count() / 64)


def test_fingerprint_edges(spark):
    found = fingerprints.neighbour_report(messy(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((k is None, k or 0) for k, _, _ in MESSY)
    assert {r["doc_id"]: r["n_chars"] for r in found}[3] == 0
    alone = fingerprints.neighbour_report(messy(spark, [(5, "abcdef", None)])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    assert rows_of(fingerprints.neighbour_report(no_rows(spark))) == []


def test_fingerprint_search(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**62, 2**62, 60).tolist()
    near = [b ^ sum(1 << int(x) for x in rng.choice(60, k, replace=False)) for b in base[:30] for k in (1, 3, 4)]
    values = sorted(set(base + near))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    asked = spark.createDataFrame([(v,) for v in base], "fp long")
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    wanted = {(a, b, distance(a, b)) for a in base for b in values if distance(a, b) <= 3}
    assert set(rows_of(fingerprints.search(df, asked, radius=3))) == wanted


def plain_vectors(rows, threshold=0.93):
    units = {}
    for key, v, label in rows:
        ok = key is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            scaled = np.array(v, np.float64) / np.abs(v).max()
            units[key] = (label, scaled / np.linalg.norm(scaled))
    near = [(a, b) for a in units for b in units if a < b and units[a][0] == units[b][0] and units[a][1] @ units[b][1] >= threshold]
    component = joined(near, units)
    count = {k: sum(k in p for p in near) for k in units}
    return {key: (count.get(key, 0), component.get(key, key)) for key, _, _ in rows}


def test_vector_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.op5_cover_tree(spark, SMALL).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == plain_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("block", [1024, 7])
def test_vector_edges(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for centre in rng.normal(size=(6, 8)):
        rows += [(len(rows) + i, (centre + rng.normal(size=8) * 0.12).tolist(), i % 2) for i in range(20)]
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(15)]
    bad = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] * 8, []]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS rep", "'x' AS tree", "'x' AS v", "1 AS n")
    found = {r["vec_id"]: (r["n_links"], r["component"]) for r in cover_tree.near_vectors(df).collect()}
    assert found == plain_vectors(rows)
    assert rows_of(cover_tree.near_vectors(df.where("false"))) == []


def test_vectors_of_any_magnitude(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1.0, 1e200, 1e-200, 1e307, 3e-310, 5e-324):
        for centre in rng.integers(-9, 10, (3, 2)):
            rows += [(len(rows) + i, ((centre + 0.5 + rng.integers(0, 2, 2)) * size).tolist(), 1) for i in range(4)]
    rows += [(len(rows), [1e-300, 1e300], 1), (len(rows) + 1, [0.0, 1e-3], 1), (len(rows) + 2, [1e200, 2e200], 2), (len(rows) + 3, [1.01e200, 2e200], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component"]) for r in cover_tree.near_vectors(df).collect()}
    assert found == plain_vectors(rows) and found[len(rows) - 1] == (1, len(rows) - 2)
