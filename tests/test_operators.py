import numpy as np
import pytest
from pyspark.sql import functions as F

from voxgrain.operators import cleaning as cl
from voxgrain.operators import collection as co
from voxgrain.operators import compliance as cp
from voxgrain.operators import language as lg
from voxgrain.operators import lemmas as le
from voxgrain.operators import metrics as me
from voxgrain.operators import quality as qu
from voxgrain.operators import scoring as sc
from voxgrain.plans import inputs as ip
from voxgrain.sources.topic import Topic


def test_quota_rule():
    topic = Topic("t", ("a",), ("brasil", "news"), limit=100)
    assert topic.quota("brasil") == 15 and topic.quota("news") == 25
    many = Topic("t", ("a",), ("brasil", "brasilivre", "politica", "worldnews", "politics", *map(str, range(18))), limit=100)
    assert many.quota("3") == 10
    assert Topic.from_mapping({"topic": "x", "keywords": ["k"], "filters": {"min_length": 9, "days_back": 3}}).min_length == 9


def test_relevance(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 10, 5, timestamp'2024-01-01 00:00:00'), (2, 0, 10, timestamp'2023-01-01 00:00:00')
        AS t(id, score, num_comments, timestamp)"""
    )
    as_of = F.lit("2024-01-16 12:00:00").cast("timestamp")
    got = {r["id"]: r["relevance"] for r in co.with_relevance(df, as_of).collect()}
    assert got[1] == pytest.approx(0.70) and got[2] == pytest.approx(0.3)
    zero = co.with_relevance(df.withColumn("score", F.lit(0)), as_of).collect()
    assert zero[0]["relevance"] == pytest.approx(0.30)


def test_first_seen_keeps_search_order(spark):
    df = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 0, 2), ("a", 1, 0, 1)], "id string, method_place int, keyword_place int, rank int")
    kept = co.first_seen(df.withColumn("subreddit", F.lit("s"))).orderBy("rank").collect()
    assert [(r["id"], r["method_place"]) for r in kept] == [("a", 0), ("b", 0)]


def test_collected_posts_respect_quota_and_are_unique(spark):
    df = ip.text_posts(spark, "/root/testdata/sf0.001").drop("search_method")
    found = co.collect_posts(df, ip.TOPIC, F.lit(ip.AS_OF).cast("timestamp_ntz")).collect()
    assert found and len({r["id"] for r in found}) == len(found) <= ip.TOPIC.limit
    sizes = {}
    for r in found:
        sizes[r["subreddit"]] = sizes.get(r["subreddit"], 0) + 1
    assert all(n <= ip.TOPIC.quota(name) for name, n in sizes.items())


@pytest.mark.parametrize("language, strict, expected", [(True, False, False), (None, False, True), (None, True, False)])
def test_short_text_validity(spark, language, strict, expected):
    ok = None if language is None else F.lit(language)
    assert spark.range(1).select(cl.validity(F.lit("abcde"), 10, 300, ok, strict)).first()[0] is expected


def test_process_and_repeats(spark):
    df = spark.createDataFrame([(1, "Os CARROS novos"), (2, "os carros, novos!"), (3, None)], "id long, text string")
    lexicon = {"carros": "carro", "novos": "novo"}
    done = cl.process_posts(df, strict=True, lexicon=lexicon)
    assert {r["lemmatized"] for r in done.collect()} == {"os carro novo"} and done.count() == 2
    assert [r["id"] for r in cl.drop_repeats(done).collect()] == [1]
    assert cl.repeat_counts(done).first().asDict() == {"rows_before": 2, "rows_after": 1, "removed": 1}
    table = spark.createDataFrame(list(lexicon.items()), "form string, lemma string")
    joined = le.lemmatize(done.drop("lemmatized"), "cleaned", "lemmatized", "id", table)
    assert {r["lemmatized"] for r in joined.collect()} == {"os carro novo"}


def test_compliance(spark):
    df = spark.createDataFrame([("ana", "mail a@b.co")], "username string, text string")
    kept = cp.anonymize_posts(df, "reddit", "s")
    assert kept.columns == ["text", "user_hash", "text_clean"] and kept.first()["text_clean"] == "mail [EMAIL]"
    audit = cp.compliance_audit(df, "twitter", "2024-01-01", {"contact_dpo": "x"}, {"access": "y"}, {"platform": "Twitter/X"}).first()
    assert audit["tos"]["platform"] == "Twitter/X" and audit["processing_info"]["columns_removed"] == ["username"]
    assert audit["lgpd"]["contact_dpo"] == "x"


def test_report_for_class_never_predicted(spark):
    pairs = [("negative", "negative"), ("neutral", "negative"), ("neutral", "neutral"), ("positive", "neutral")]
    df = spark.createDataFrame(pairs, "y string, p string")
    report = {r["name"]: r for r in me.classification_report(df, "y", "p").collect()}
    assert report["positive"]["precision"] == 0 and report["positive"]["f1"] == 0
    assert report["negative"]["precision"] == 0.5 and report["negative"]["recall"] == 1
    assert report["accuracy"]["f1"] == 0.5 and report["macro avg"]["recall"] == pytest.approx(0.5)
    assert sum(r["n"] for r in me.confusion_matrix(df, "y", "p").collect()) == 4
    assert me.score_summary(df, "y", "p").first()["accuracy"] == 0.5


def test_quality_levels_and_advice(spark):
    scores = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 10.0)], "metric string, score double")
    got = {r["metric"]: r["status"] for r in qu.quality_verdict(scores).collect()}
    assert got == {"a": "good", "b": "fair", "c": "poor", "overall": "MODERATE"}
    df = spark.sql("SELECT id % 2 AS id, timestamp'2024-01-01 00:00:00' AS timestamp FROM range(4)")
    assert qu.recommendations(df).count() == 3
    assert {r["kind"]: r["repeats"] for r in qu.repeat_counts(df, {"id": ["id"]}).collect()} == {"id": 2}


def test_language_of_unknown_text(spark):
    df = spark.createDataFrame([(1, "the cat the hat", "en"), (2, "der hund und die katze", "de"), (3, "", None)], "id int, text string, lang string")
    profile = lg.language_profile(df, "text", "lang", ["de", "en"], 500)
    got = {r["id"]: r["detected_lang"] for r in lg.detect_language(df, "text", "id", profile, ["de", "en"]).collect()}
    assert got == {1: "en", 2: "de", 3: lg.UNKNOWN}


def test_sentence_vectors_by_lookup_and_join_agree(spark):
    vectors = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "word string, vector array<float>"
    )
    texts = spark.createDataFrame([(1, "a b"), (2, "a a b x"), (3, "x"), (4, None), (5, "z")], "id int, text string")
    lookup = {r["id"]: r["vector"] for r in sc.sentence_vectors(texts, "text", "id", vectors, 2).collect()}
    joined = {r["id"]: r["vector"] for r in sc.sentence_vectors(texts, "text", "id", vectors, 2, limit_bytes=8).collect()}
    expected = {1: [0.3, 0.9], 2: [0.4, 2.6 / 3], 3: [0, 0], 4: [0, 0], 5: [0, 0]}
    for number, vector in expected.items():
        assert lookup[number] == pytest.approx(vector, abs=1e-6) and joined[number] == pytest.approx(vector, abs=1e-6)


def test_forward_pass(spark):
    layers = [(np.array([[1.0, -1.0]]), np.array([0.0, 0.0])), (np.eye(2), np.array([0.0, 1.0]))]
    df = spark.createDataFrame([([2.0],)], "x array<double>")
    got = df.select(sc.forward_pass("x", layers)).first()[0]
    assert got == pytest.approx([np.e**2 / (np.e**2 + np.e), np.e / (np.e**2 + np.e)])
