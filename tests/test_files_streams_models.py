import datetime

import pytest
from pyspark.sql import functions as F

from voxgrain.operators import models as mo
from voxgrain.sources import files as fl
from voxgrain.sources import schemas
from voxgrain.streaming import posts as st


def test_scratch_lies_in_the_shared_folder(spark):
    assert fl.scratch_folder(spark, "x").startswith(spark.conf.get(fl.CHECKPOINT_SETTING))


def test_csv_keeps_texts_whole(spark):
    df = spark.createDataFrame([(1, ' a "b",\nc\\ '), (2, "é;x")], "id long, text string")
    path = fl.write_posts(df, fl.scratch_folder(spark, "csv"), "csv")
    assert sorted(map(tuple, fl.read_posts(spark, path, "csv", df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_usable_and_corrupt(spark):
    good, lacking = fl.usable({"a": spark.range(1).withColumn("text", F.lit("x")), "b": spark.range(1)}, ["text"])
    assert list(good) == ["a"] and lacking == {"b": ["text"]}
    lines = spark.createDataFrame([('{"id": "1"}',), ("{oops",)], "value string")
    rows, bad = fl.split_corrupt(lines, schemas.SUBMISSIONS)
    assert rows.first()["id"] == "1" and [r["line"] for r in bad.collect()] == ["{oops"]


def test_inventory_counts_bytes(spark):
    path = fl.write_posts(spark.range(10), fl.scratch_folder(spark, "inventory"))
    row = fl.file_inventory(fl.list_files(spark, path, "*.parquet")).agg(F.sum("files"), F.sum("bytes")).first()
    assert row[0] >= 1 and row[1] > 0
    with pytest.raises(FileNotFoundError):
        fl.newest_dataset(spark, path, "*.nothing")


def test_comparison_notices_a_change(spark):
    df = spark.range(10)
    assert fl.compare_written(df, df).first()["same_content"]
    other = fl.compare_written(df, df.select((F.col("id") + 1).alias("id"))).first()
    assert other["same_count"] and not other["same_content"]


def land(spark, root, rows):
    frame = spark.createDataFrame(rows, "id long, timestamp timestamp, sentiment string")
    fl.write_posts(frame.coalesce(1), root, mode="append")
    return frame.schema


def test_append_emits_closed_windows_and_drops_late_rows(spark):
    root, out, state = (fl.scratch_folder(spark, n) for n in ("land", "out", "state"))
    at = lambda hour, minute=0: datetime.datetime(2024, 1, 1, hour, minute)
    schema = land(spark, root, [(1, at(1), "positive"), (2, at(1, 30), "positive"), (3, at(6), "neutral")])
    run = lambda: st.append_to_files(
        st.hourly_counts(st.event_time(st.ingest(spark, root, schema), "timestamp", "1 hour"), "timestamp", "sentiment"), out, state
    ).awaitTermination()
    run()
    land(spark, root, [(4, at(1, 10), "positive"), (5, at(9), "neutral")])
    run()
    got = sorted((r["hour"].hour, r["sentiment"], r["n"]) for r in spark.read.parquet(out).collect())
    assert (1, "positive", 2) in got and all(hour < 9 for hour, _, _ in got)


@pytest.fixture(scope="module")
def fitted(spark):
    texts = {"positive": "dia bom sol", "negative": "noite ruim chuva", "neutral": "tarde normal nuvem"}
    rows = [(i * 3 + j, f"{text} {'x' * (i % 3 + 2)}", name) for i in range(10) for j, (name, text) in enumerate(texts.items())]
    df = spark.createDataFrame(rows, "id long, text string, sentiment string")
    return df, mo.fit_baseline(df, "text", max_iterations=15)


def test_baseline_learns_and_probabilities_sum_to_one(fitted):
    df, model = fitted
    scored = mo.baseline_scores(model, df)
    assert scored.where("sentiment <> predicted_sentiment").count() == 0
    assert scored.where("abs(prob_negative + prob_neutral + prob_positive - 1) > 1e-9").count() == 0
    assert set(scored.columns) == {
        "id", "text", "sentiment", "predicted_sentiment", "confidence", "prob_negative", "prob_neutral", "prob_positive"
    }
    top = mo.top_features(mo.coefficients(df.sparkSession, model), 3)
    best = top.where("sentiment = 'positive' AND direction = 'positive'").select("term").collect()
    assert {"bom", "dia bom", "bom sol"} & {r["term"] for r in best}


def test_absent_class_gets_no_probability(fitted):
    df, _ = fitted
    two = df.where("sentiment <> 'neutral'")
    model = mo.fit_baseline(two, "text", max_iterations=10)
    assert set(mo.class_stages(model)) == {"negative", "positive"}
    assert mo.baseline_scores(model, df).where("prob_neutral <> 0").count() == 0


def test_fold_summary(spark):
    scores = spark.createDataFrame(
        [(0, 0.5, 0.5, 0.5, 0.5), (1, 1.0, 1.0, 1.0, 1.0)],
        "fold int, accuracy double, f1_macro double, precision_macro double, recall_macro double",
    )
    got = {r["metric"]: (r["mean"], r["std"]) for r in mo.cross_validation_summary(scores).collect()}
    assert got["f1_macro"] == (0.75, 0.25)


def test_too_many_words_are_refused(spark):
    df = spark.createDataFrame([("a a b b c c",)], "text string")
    with pytest.raises(mo.TooManyWords):
        mo.train_word_vectors(df, "text", 4, 1, max_words=2)


def test_no_number_of_words_is_refused(spark):
    n = 210_000
    many = spark.range(n // 100).selectExpr("concat_ws(' ', transform(sequence(id * 100, id * 100 + 99), x -> concat('w', x))) AS text")
    vectors = mo.train_word_vectors(many.union(many), "text", 4, 1).persist()
    assert vectors.count() == n == vectors.selectExpr("count(DISTINCT word)").first()[0]
    assert vectors.where("size(vector) <> 4 OR exists(vector, x -> x IS NULL OR isnan(x))").count() == 0
    vectors.unpersist()


def test_few_buckets_still_tell_words_apart(spark):
    df = spark.createDataFrame([("river river hills hills sun sun once",)], "text string")
    vectors = {r["word"]: tuple(r["vector"]) for r in mo.train_word_vectors(df, "text", 8, 1, buckets=64).collect()}
    assert set(vectors) == {"river", "hills", "sun"} and len(set(vectors.values())) == 3


def test_jobs_from_raw_posts_to_predictions(spark):
    from voxgrain.plans import jobs

    words = ("bom sol", "ruim chuva", "nuvem normal")
    rows = [(i, f"Dia {i % 13} {words[i % 3]}!", "reddit" if i % 2 else "twitter") for i in range(60)]
    posts = spark.createDataFrame(rows, "id long, text string, platform string")
    root = fl.scratch_folder(spark, "jobs")
    paths = jobs.preprocess({"a": posts, "b": spark.range(3)}, root, "1", strict=True)
    assert len(paths) == 1
    done = spark.read.parquet(paths[0])
    combined = jobs.preprocess({"a": posts, "c": posts}, root, "2", combine=True, strict=True)
    assert spark.read.parquet(combined[0]).count() == done.select("lemmatized").distinct().count()
    model = jobs.train(done, f"{root}/trained", "now", folds=2, max_iterations=5)
    matrix = jobs.predict(done, model, root, "3")
    assert {r["platform"]: r["total"] for r in matrix.collect()} == {"reddit": 30, "twitter": 30}
    assert spark.read.json(f"{root}/trained/report").first()["samples"] == 60
    report = jobs.assess(done)
    assert {"missing", "repeats", "coverage", "verdict", "advice"} <= set(report)
    assert {r["kind"] for r in report["repeats"].collect()} >= {"rows", "text"} and report["coverage"].count() >= 1
