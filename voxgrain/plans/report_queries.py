"""Registered queries: predictions and the report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.operators import cleaning as cl
from voxgrain.operators import models as mo
from voxgrain.operators import report as rp
from voxgrain.operators.labels import CLASSES, weak_label
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql

LEAST_CONFIDENCE = 0.4


def hourly_sentiment(spark, sf_dir):
    """Clean, keep valid texts, drop repeats, label and count per hour."""
    valid = cl.process_posts(
        ip.text_posts(spark, sf_dir), min_length=ip.MIN_LENGTH, max_length=ip.MAX_LENGTH, strict=True
    )
    # Labelled before repeats are dropped, so that only digests and labels are shuffled.
    label = weak_label("lemmatized", "id", ip.GOOD_WORDS, ip.BAD_WORDS)
    unique = cl.drop_repeats(valid.select("id", "timestamp", "lemmatized", label.alias("predicted_sentiment")))
    return rp.hourly_sentiment(unique)


def scored_records(spark, sf_dir):
    """Nested prediction records, flattened again to the five prediction columns."""
    share = lambda name: F.when(F.col("predicted_sentiment") == name, F.col("confidence")).otherwise(
        (1 - F.col("confidence")) / 2
    ).alias(f"prob_{name}")
    flat = ip.scored_posts(spark, sf_dir).select("id", "text", "predicted_sentiment", "confidence", *[share(c) for c in CLASSES])
    nested = flat.select("id", mo.prediction_record("text").alias("record"))
    return ip.rounded(mo.flatten_prediction(nested, "record"))


def kpi(spark, sf_dir):
    return rp.key_figures(ip.scored_posts(spark, sf_dir))


def kpi_filtered(spark, sf_dir):
    df = rp.at_least(rp.for_platform(ip.scored_posts(spark, sf_dir), "reddit"), LEAST_CONFIDENCE)
    return rp.key_figures(df)


def platform_share(spark, sf_dir):
    return rp.platform_shares(ip.scored_posts(spark, sf_dir))


def platform_matrix(spark, sf_dir):
    return rp.platform_matrix(ip.scored_posts(spark, sf_dir))


def confidence_hist(spark, sf_dir):
    return ip.rounded(rp.confidence_histogram(ip.scored_posts(spark, sf_dir)))


def sentiment_share(spark, sf_dir):
    return rp.sentiment_shares(ip.scored_posts(spark, sf_dir))


def sample_per_class(spark, sf_dir):
    return rp.sample_per_class(ip.scored_posts(spark, sf_dir), "id").select("id", "predicted_sentiment", "sample_place", "class_place")


def sample_display(spark, sf_dir):
    scored = ip.scored_posts(spark, sf_dir).withColumn("lemmatized", tx.clean_text("text"))
    shown = F.when(F.col("id") % 2 == 0, F.col("platform"))
    return rp.display_rows(rp.sample_per_class(scored.withColumn("platform", shown), "id"), "id")


def prediction_stats(spark, sf_dir):
    return ip.rounded(rp.prediction_stats(ip.scored_posts(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        hourly_sentiment, scored_records, kpi, kpi_filtered, platform_share, platform_matrix, confidence_hist,
        sentiment_share, sample_per_class, sample_display, prediction_stats,
    )
}

_COUNT = lambda name: f"count(*) FILTER (predicted_sentiment = '{name}')"
_KPI = "SELECT count(*) AS total_posts, " + ", ".join(
    f"{sql.tenths(_COUNT(c), 'count(*)')} AS {c}_pct" for c in rp.REPORT_ORDER
)
_SAMPLED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY predicted_sentiment ORDER BY {sql.draw('id')}, id) AS place
    FROM scored) WHERE place <= 5"""
_PLACE = "CASE predicted_sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END"

SQL = {
    "hourly_sentiment": sql.with_posts(
        """SELECT date_trunc('hour', "timestamp") AS hour, predicted_sentiment, count(*) AS n FROM labelled GROUP BY 1, 2""",
        valid=f"""SELECT id, "timestamp", lemmatized FROM (SELECT *, {sql.cleaned('text')} AS lemmatized FROM posts)
            WHERE length(lemmatized) BETWEEN {ip.MIN_LENGTH} AND {ip.MAX_LENGTH}""",
        once="SELECT * FROM valid WHERE id IN (SELECT min(id) FROM valid GROUP BY lemmatized)",
        labelled=f"SELECT *, {sql.weak_label('lemmatized', 'id')} AS predicted_sentiment FROM once",
    ),
    "scored_records": sql.with_scored(
        "SELECT id, predicted_sentiment, round(confidence, 6) AS confidence, "
        + ", ".join(
            f"round(CASE WHEN predicted_sentiment = '{c}' THEN confidence ELSE (1 - confidence) / 2 END, 6) AS prob_{c}" for c in CLASSES
        )
        + " FROM scored"
    ),
    "kpi": sql.with_scored(_KPI + " FROM scored"),
    "kpi_filtered": sql.with_scored(_KPI + f" FROM scored WHERE platform = 'reddit' AND confidence >= {LEAST_CONFIDENCE}"),
    "platform_share": sql.with_scored(
        " UNION ALL ".join(
            f"SELECT platform, '{c}' AS sentiment, {sql.percent(_COUNT(c), 'count(*)')} AS pct FROM scored GROUP BY platform"
            for c in rp.REPORT_ORDER
        )
    ),
    "platform_matrix": sql.with_scored(
        "SELECT platform, "
        + ", ".join(f"{_COUNT(c)} AS {c}, {sql.percent(_COUNT(c), 'count(*)')} AS {c}_pct" for c in CLASSES)
        + ", count(*) AS total FROM scored GROUP BY platform"
    ),
    "confidence_hist": sql.with_scored(
        """SELECT bin, round(bin / 20.0::DOUBLE, 6) AS low, round((bin + 1) / 20.0::DOUBLE, 6) AS high, count(*) AS n
        FROM (SELECT CAST(least(floor(confidence * 20), 19) AS INTEGER) AS bin FROM scored) GROUP BY bin"""
    ),
    "sentiment_share": sql.with_scored(
        f"""SELECT predicted_sentiment, count(*) AS n, {sql.percent('count(*)', '(SELECT count(*) FROM scored)')} AS pct
        FROM scored GROUP BY predicted_sentiment"""
    ),
    "sample_per_class": sql.with_scored(
        f"""SELECT id, predicted_sentiment, CAST(place AS INTEGER) AS sample_place, {_PLACE} AS class_place FROM sampled""", sampled=_SAMPLED
    ),
    "sample_display": sql.with_scored(
        f"""SELECT id, {_PLACE} AS class_place, CAST(place AS INTEGER) AS sample_place,
        CASE WHEN id % 2 = 0 THEN platform ELSE 'N/A' END AS platform, predicted_sentiment AS sentiment,
        printf('%.2f', round(confidence, 2)) AS confidence,
        CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS text,
        strftime("timestamp", '%Y-%m-%d %H:%M') AS time FROM (SELECT *, {sql.cleaned('text')} AS t FROM sampled)""",
        sampled=_SAMPLED,
    ),
    "prediction_stats": sql.with_scored(
        "SELECT count(*) AS total_predictions, "
        + ", ".join(f"{_COUNT(c)} AS {c}, {sql.percent(_COUNT(c), 'count(*)')} AS {c}_pct" for c in CLASSES)
        + """, round(avg(confidence), 6) AS avg_confidence, round(stddev_samp(confidence), 6) AS std_confidence,
        round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence,
        count(*) FILTER (confidence > 0.8) AS high_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence,
        round(quantile_cont(confidence, 0.25), 6) AS q25_confidence, round(quantile_cont(confidence, 0.5), 6) AS q50_confidence,
        round(quantile_cont(confidence, 0.75), 6) AS q75_confidence FROM scored"""
    ),
}
