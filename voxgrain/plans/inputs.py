"""The given tables as posts, and the parameters the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.functions import text as tx
from voxgrain.operators.labels import weak_label, word_hits
from voxgrain.sources.files import spread
from voxgrain.sources.topic import Topic

# Words that occur in the given texts stand in for the topic and sentiment words.
KEYWORDS = ("estion", "keit", "éou", "ndon", "ich")
GOOD_WORDS = ("estion", "keit", "éou", "ndon")
BAD_WORDS = ("atou", "èai", "ndat", "ingor")
LEXICON = {"the": "der", "is": "be", "was": "be", "are": "be", "les": "le", "des": "de", "éle": "él", "thatin": "that"}
SALT = "query-salt"
AS_OF = "2024-01-31 00:00:00"
TARGET_LANGUAGE = "en"
MIN_LENGTH, MAX_LENGTH = 15, 1500
TOPIC = Topic(
    name="Given Texts - Sample",
    keywords=KEYWORDS,
    communities=tuple(f"src{i}" for i in range(20)),
    limit=400,
    methods=("hot", "top", "new", "rising"),
    min_length=MIN_LENGTH,
    max_length=MAX_LENGTH,
    min_score=5,
    language=TARGET_LANGUAGE,
    priority=tuple(f"src{i}" for i in range(5)),
    language_tested=("src3", "src7", "src11"),
)
PROFILE_GRAMS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for work that is bound by the CPU, spread over the cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def posts(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """Documents with the event of the same number as a post each."""
    texts = table(spark, sf_dir, "documents") if texts is None else texts
    events = table(spark, sf_dir, "events")
    joined = texts.join(events, texts["doc_id"] == events["event_id"])
    body = F.instr("text", "\n")
    return joined.select(
        F.col("doc_id").alias("id"),
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(body > 0, F.substring(F.col("text"), body + 1, F.length("text"))).otherwise(F.lit("")).alias("selftext"),
        "lang",
        F.col("source").alias("subreddit"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("twitter")).otherwise(F.lit("reddit")).alias("platform"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        (F.col("value") + 0.0).alias("score"),
        F.get_json_object("props", "$.k").cast("int").alias("num_comments"),
        F.col("event_type").alias("search_method"),
    )


def text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir, documents(spark, sf_dir))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a lexicon label and the smoothed share of its words as confidence."""
    df = text_posts(spark, sf_dir)
    good, bad = word_hits("text", GOOD_WORDS), word_hits("text", BAD_WORDS)
    marked = df.withColumns({"_good": good, "_bad": bad})
    confidence = (F.greatest("_good", "_bad") + 1.0) / (F.col("_good") + F.col("_bad") + 3.0)
    label = weak_label("text", "id", GOOD_WORDS, BAD_WORDS)
    return marked.withColumn("predicted_sentiment", label).withColumn("confidence", confidence).drop("_good", "_bad")


def labelled_documents(spark: SparkSession, sf_dir: str, cleaned: bool = True) -> DataFrame:
    """Documents with a human label: toxic is negative, good quality positive, else neutral."""
    labels = table(spark, sf_dir, "labels")
    sentiment = (
        F.when(F.col("toxic") == 1, F.lit("negative"))
        .when(F.col("quality") == 1, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )
    joined = documents(spark, sf_dir).join(labels.select("doc_id", sentiment.alias("sentiment")), "doc_id")
    text = tx.clean_text("text") if cleaned else F.col("text")
    return joined.select(F.col("doc_id").alias("id"), text.alias("text"), "sentiment")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all double columns, so that the order of additions does not show."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    )
