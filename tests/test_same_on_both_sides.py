"""Paths chosen by size give one result, also for null and repeated keys, groups and texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from voxgrain.operators import language, lemmas, quality, ranking, scoring
from voxgrain.sources import files

ROWS = [(1, "the cat"), (1, "big dogs run"), (None, "a dogs"), (None, None), (2, "the cat")]
FORMS = {"dogs": "dog", "cat": "kitty"}


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lemmas(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    many = FORMS | {f"form{i}": f"lemma{i}" for i in range(lemmas.LITERAL_ENTRIES)}
    table = spark.createDataFrame([*FORMS.items(), ("dogs", "zog")], "form string, lemma string")
    wanted = sorted_rows(lemmas.lemmatize(df, "text", "out", "id", FORMS))
    assert (None, "a dogs", "a dog") in wanted and (None, None, None) in wanted and len(wanted) == 5
    assert sorted_rows(lemmas.lemmatize(df, "text", "out", "id", many)) == wanted
    assert sorted_rows(lemmas.lemmatize(df, "text", "out", "id", table)) == wanted


@pytest.mark.parametrize("limit", [lemmas.LOOKUP_BYTES, 0])
def test_lemma_tables(spark, monkeypatch, limit):
    """Small tables shuffle no text; larger ones are joined with each text's distinct words. Both give the same lemmas."""
    monkeypatch.setattr(lemmas, "LOOKUP_BYTES", limit)
    rows = [*ROWS, (3, ""), (3, " cat  dogs "), (4, "dogs cat dogs cat"), (4, "Éle dogs"), (5, "none known")]
    df = spark.createDataFrame(rows, "id long, text string")
    table = spark.createDataFrame([*FORMS.items(), ("dogs", "zog"), ("big", None), (None, "x"), ("Éle", "él"), ("the", "")], "form string, lemma string")
    found = lemmas.lemmatize(df, "text", "out", "id", table)
    told = {**FORMS, "Éle": "él", "the": ""}
    assert found.columns == ["id", "text", "out"]
    assert sorted_rows(found) == sorted(((i, t, t and " ".join(told.get(w, w) for w in t.split(" "))) for i, t in rows), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and ("Exchange" in plan) == (limit == 0)


def test_sentence_vectors(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    vectors = spark.createDataFrame([("cat", [3.0, 4.0]), ("dogs", [0.0, 2.0]), ("the", [1.0, 0.0])], "word string, vector array<float>")
    lookup, join = (sorted_rows(scoring.sentence_vectors(df, "text", "id", vectors, 2, limit)) for limit in (1 << 20, 0))
    assert [k for k, _ in lookup] == [k for k, _ in join]
    for (_, a), (_, b) in zip(lookup, join):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles(spark, by):
    rows = [("a" if i % 3 == 0 else None, i % 2, float(i * 7 % 31)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, h int, x double")
    counts = ranking.value_counts(df, "x", by)
    few = ranking.exact_quantiles(df, "x", [0.25, 0.5, 0.95], by)
    many = ranking.quantiles_in_slots(counts, "x", [0.25, 0.5, 0.95], by)
    assert few.columns == many.columns and sorted_rows(few) == sorted_rows(many)


def test_too_many_languages(spark, monkeypatch):
    df = spark.createDataFrame([("de",), ("fr",), (None,)], "lang string")
    assert language.language_list(df, "lang") == ["de", "fr"]
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.language_list(df, "lang")


def test_repeats_tell_microseconds_and_neighbours_apart(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at, "a", "b"), (at + datetime.timedelta(microseconds=100), "a", "b"), (at, "ab", None), (at, None, "ab"), (at, None, "ab")]
    df = spark.createDataFrame(rows, "t timestamp, x string, y string")
    assert sorted_rows(quality.repeat_counts(df, {"all": ["t", "x", "y"], "xy": ["x", "y"]})) == [("all", 1), ("xy", 2)]


def test_checksum_tells_nulls_apart(spark):
    left, right = (spark.createDataFrame([r], "a string, b string") for r in ((None, "x"), ("x", None)))
    assert files.compare_written(left, right).first()["same_content"] is False


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,text,score\n1,hello,9\n")
    (tmp_path / "two.csv").write_text("text,id\nworld,2\n")
    found = files.read_posts(spark, str(tmp_path), "csv", pattern="*.csv", with_source=True)
    assert sorted_rows(found.select("id", "text", "score", "file_source")) == [("1", "hello", "9", "one"), ("2", "world", None, "two")]


def test_newest_of_a_flat_folder(spark, tmp_path):
    import os

    for age, name in ((20, "a"), (5, "b"), (10, "c")):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"id\n{name}\n")
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    newest = files.newest_dataset(spark, str(tmp_path), "*.csv")
    assert [r["id"] for r in files.read_posts(spark, newest, "csv").collect()] == ["b"]


def test_job_reads_each_file(spark, tmp_path):
    from voxgrain.plans import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("id,text\n1,hello there world\n")
    (tmp_path / "in" / "two.csv").write_text("text,id\nanother text here,2\n")
    (tmp_path / "in" / "bad.csv").write_text("id,words\n3,x\n")
    given = ["preprocess", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--run-id", "r"]
    jobs.main(given)
    one, two = (spark.read.parquet(str(tmp_path / "out" / f"processed_{n}_r")).first() for n in ("one", "two"))
    assert (one["id"], one["cleaned"], two["id"], two["text"]) == ("1", "hello there world", "2", "another text here")
    assert not (tmp_path / "out" / "processed_bad_r").exists()
    jobs.main([*given, "--combine"])
    assert spark.read.parquet(str(tmp_path / "out" / "combined_processed_r")).count() == 2
