"""Schemas of the known tables."""

from __future__ import annotations

from pyspark.sql import types as T

_text, _long, _double, _time = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


SUBMISSIONS = _fields(
    ("id", _text), ("title", _text), ("selftext", _text), ("created_utc", _long), ("author", _text),
    ("score", _long), ("upvote_ratio", _double), ("num_comments", _long), ("subreddit", _text), ("permalink", _text),
)
POSTS_RAW = _fields(
    ("platform", _text), ("id", _text), ("text", _text), ("title", _text), ("selftext", _text),
    ("timestamp", _time), ("user_hash", _text), ("username", _text), ("score", _long), ("upvote_ratio", _double),
    ("num_comments", _long), ("subreddit", _text), ("url", _text), ("search_method", _text),
    ("search_keyword", _text), ("collected_at", _time),
)
POSTS_PROCESSED = T.StructType(
    POSTS_RAW.fields
    + _fields(
        ("original", _text), ("cleaned", _text), ("lemmatized", _text),
        ("is_valid", T.BooleanType()), ("length", T.IntegerType()),
    ).fields
)
POSTS_LABELED = T.StructType(POSTS_PROCESSED.fields + _fields(("sentiment", _text)).fields)
PREDICTIONS = T.StructType(
    POSTS_PROCESSED.fields
    + _fields(
        ("predicted_sentiment", _text), ("confidence", _double), ("prob_negative", _double),
        ("prob_neutral", _double), ("prob_positive", _double),
    ).fields
)
