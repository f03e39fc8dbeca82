"""Cleaning and collection: what their plans do once, and the search's time filter."""

import datetime

import pytest
from pyspark.sql import functions as F

from voxgrain.operators import cleaning as cl
from voxgrain.operators import collection as co
from voxgrain.plans import jobs
from voxgrain.sources import files as fl
from voxgrain.sources.topic import Topic


def landed(spark):
    day = datetime.datetime(2024, 1, 31)
    rows = [
        (str(i), f"a long enough text about rain number {i}", "t", "b", "x", day - datetime.timedelta(days=i), f"u{i}", float(i), i)
        for i in range(40)
    ]
    names = "id string, text string, title string, selftext string, subreddit string, timestamp timestamp, user_hash string, score double, num_comments int"
    return spark.createDataFrame(rows, names)


def topic(**more):
    return Topic(name="Rain Report", keywords=("rain",), communities=("x",), methods=("new",), limit=100, priority=(), language_tested=(), **more)


def test_texts_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, "Some TEXT here", "en"), (2, None, "en"), (3, "Some text here", None)], "id long, text string, lang string")
    done = cl.drop_repeats(cl.process_posts(df, language_ok=F.col("lang") == "en")).select("id", "lemmatized", "length")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?") == 1
    assert [tuple(r) for r in done.collect()] == [(1, "some text here", 14)]


def test_repeats_keep_null_texts_and_keys(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (None, "b"), (4, None), (3, None), (5, "")], "id long, text string")
    kept = {tuple(r) for r in cl.drop_repeats(df, "text").collect()}
    assert kept == {(1, "a"), (None, "b"), (3, None), (5, "")}


@pytest.mark.parametrize("period, days", [("day", 1), ("week", 7), ("month", 30), ("all", 39)])
def test_time_filter(spark, period, days):
    found = co.search_candidates(landed(spark), topic(time_filter=period), F.lit("2024-01-31").cast("timestamp"))
    assert {int(r["id"]) for r in found.collect()} == set(range(days + 1))


def test_unknown_time_filter():
    with pytest.raises(ValueError):
        topic(time_filter="decade")
    assert Topic.from_mapping({"reddit": {"time_filter": "week"}}).time_filter == "week"


def test_collect_job(spark):
    root = fl.scratch_folder(spark, "collected")
    path, stats = jobs.collect(landed(spark), topic(), F.lit("2024-01-31").cast("timestamp"), root, "1")
    assert "rain_report" in path
    written = fl.read_posts(spark, path)
    # The top-up looks at hot posts of any age, so it adds those that are too old for the searches.
    assert {r["search_method"]: r["count"] for r in written.groupBy("search_method").count().collect()} == {"new": 31, "hot_general": 9}
    assert stats.first()["total_posts"] == 40
