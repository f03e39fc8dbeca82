"""Registered queries: profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.operators import profiles as pf
from voxgrain.operators import profiling as pr
from voxgrain.operators import quality as qu
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql
from voxgrain.sources import files as fl

LENGTH_WIDTH, SCORE_WIDTH = 500, 25


def _lengths(spark, sf_dir):
    return pr.with_length(ip.table(spark, sf_dir, "documents"), "text")


def _post_lengths(spark, sf_dir):
    return pr.with_length(ip.posts(spark, sf_dir), "text")


def describe_length(spark, sf_dir):
    return ip.rounded(pr.describe(_lengths(spark, sf_dir), "text_length"))


def hist_length(spark, sf_dir):
    return ip.rounded(pr.histogram(_lengths(spark, sf_dir), "text_length"))


def hist_cleaned_length(spark, sf_dir):
    cleaned = ip.documents(spark, sf_dir).select(F.length(tx.clean_text("text")).alias("cleaned_length"))
    return ip.rounded(pr.histogram(cleaned, "cleaned_length"))


def box_by_platform(spark, sf_dir):
    return ip.rounded(pr.box_summary(_post_lengths(spark, sf_dir), "text_length", "platform"))


def term_top100(spark, sf_dir):
    return ip.rounded(pr.term_counts(ip.documents(spark, sf_dir), "text", 100))


def term_top_without_stop_words(spark, sf_dir):
    """The most frequent words of the shorter ``benchmark`` texts are the stop words here."""
    stop = pr.term_counts(ip.table(spark, sf_dir, "benchmark"), "text", 10)
    return ip.rounded(pr.term_counts(ip.documents(spark, sf_dir), "text", 100, stop))


def posts_per_day(spark, sf_dir):
    return pr.posts_per_day(ip.table(spark, sf_dir, "events"), "ts")


def temporal_summary(spark, sf_dir):
    return ip.rounded(pr.temporal_summary(ip.table(spark, sf_dir, "events"), "ts"))


def platform_length(spark, sf_dir):
    return ip.rounded(pr.count_and_length_by(ip.posts(spark, sf_dir), "platform", "text"))


def platform_posts(spark, sf_dir):
    return pr.count_by(ip.posts(spark, sf_dir), "platform")


def iqr_outliers(spark, sf_dir):
    return ip.rounded(pr.length_outliers(_lengths(spark, sf_dir), "text_length"))


def short_long(spark, sf_dir):
    return pr.short_and_long(_lengths(spark, sf_dir), "text_length")


def length_examples(spark, sf_dir):
    return pr.length_examples(ip.table(spark, sf_dir, "documents"), "text", "doc_id")


def eda_summary(spark, sf_dir):
    return ip.rounded(pr.eda_summary(ip.posts(spark, sf_dir), "text", "timestamp", "platform"))


def missing_values(spark, sf_dir):
    """Posts left-joined with their labels, which many lack."""
    labels = ip.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return qu.missing_values(ip.posts(spark, sf_dir).join(labels, "id", "left"))


def duplicate_counts(spark, sf_dir):
    df = ip.table(spark, sf_dir, "documents")
    keys = {"rows": ["text", "lang", "source", "n_chars"], "id": ["doc_id"], "text": ["text"]}
    return qu.repeat_counts(df, keys)


def date_span(spark, sf_dir):
    return pr.date_span(ip.table(spark, sf_dir, "events"), "ts")


def day_extremes(spark, sf_dir):
    return ip.rounded(pr.day_extremes(ip.table(spark, sf_dir, "events"), "ts"))


def coverage(spark, sf_dir):
    return ip.rounded(qu.coverage(ip.posts(spark, sf_dir), ["text", "title", "selftext"]))


def engagement(spark, sf_dir):
    return ip.rounded(pr.column_stats(ip.posts(spark, sf_dir), ["score", "num_comments"]))


def _one_of(row, columns):
    """The value of the one-row table's column that column_name names."""
    found = F.lit(None)
    for c in columns:
        found = F.when(F.col("column_name") == c, row.select(c).scalar()).otherwise(found)
    return found


def merged_profiles(spark, sf_dir):
    """Profiles of each day's events, written as runs and merged: their figures, exact quartiles, and whether the sketches are near the truth."""
    events = ip.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("amount"), F.col("user_id").alias("member"), F.dayofweek("ts").alias("run"))
    columns = ["amount", "member"]
    path = fl.scratch_folder(spark, "profiles")
    pf.profile(events, columns, ["run"]).write.partitionBy("run").parquet(path)
    found = fl.materialize(pf.merged(spark.read.parquet(path).drop("run")))
    exact = pf.exact_quantiles(events, found, (0.25, 0.5, 0.75))
    truth = events.agg(*[F.count_distinct(c).alias(c) for c in columns])
    about = pf.figures(found, (0.5,)).join(exact, "column_name")
    return ip.rounded(about.select(
        "column_name", "n", "nulls", "mean", "std", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "q25", "q50", "q75",
        (F.abs(F.col("about_distinct") - _one_of(truth, columns)) <= 0.05 * _one_of(truth, columns)).alias("distinct_near"),
        ((F.col("about_q50") >= F.col("q25")) & (F.col("about_q50") <= F.col("q75"))).alias("median_near"),
    ))


def top_communities(spark, sf_dir):
    return pr.share_by(ip.table(spark, sf_dir, "documents"), "source", 10)


def distinct_communities(spark, sf_dir):
    return ip.table(spark, sf_dir, "documents").groupBy("source").count().agg(F.count(F.lit(1)).alias("communities"))


def method_keyword_share(spark, sf_dir):
    df = ip.text_posts(spark, sf_dir)
    keyed = df.withColumn("search_keyword", F.get(tx.matched_keywords("text", ip.KEYWORDS), F.lit(0)))
    shares = [
        pr.share_by(keyed, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"), "n", "pct")
        for c in ("search_method", "search_keyword")
    ]
    return shares[0].unionByName(shares[1])


def _quality_posts(spark, sf_dir):
    labels = ip.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return ip.posts(spark, sf_dir).join(labels, "id", "left")


def quality_scores(spark, sf_dir):
    return ip.rounded(qu.quality_scores(_quality_posts(spark, sf_dir)))


def quality_verdict(spark, sf_dir):
    return ip.rounded(qu.quality_verdict(qu.quality_scores(_quality_posts(spark, sf_dir))))


def recommendations(spark, sf_dir):
    return qu.recommendations(ip.posts(spark, sf_dir), keys=["text", "lang", "subreddit"])


def length_score_bins(spark, sf_dir):
    return pr.length_score_bins(_post_lengths(spark, sf_dir), "text_length", "score", LENGTH_WIDTH, SCORE_WIDTH)


def length_score_corr(spark, sf_dir):
    return ip.rounded(pr.length_score_correlation(_post_lengths(spark, sf_dir), "text_length", "score"))


def example_rows(spark, sf_dir):
    return pr.example_rows(ip.table(spark, sf_dir, "documents"), "text", "doc_id")


def detect_columns(spark, sf_dir):
    return pr.detect_columns(ip.posts(spark, sf_dir))


def detect_columns_by_length(spark, sf_dir):
    """No name fits here, so text columns are found by their mean length."""
    renamed = ip.table(spark, sf_dir, "documents").select(F.col("text").alias("a"), F.col("lang").alias("b"), F.col("source"))
    return pr.detect_columns(renamed)


def preview(spark, sf_dir):
    return pr.preview(ip.table(spark, sf_dir, "documents"), "doc_id", 5)


def column_overview(spark, sf_dir):
    return pr.column_overview(ip.table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        describe_length, hist_length, hist_cleaned_length, box_by_platform, term_top100, term_top_without_stop_words,
        posts_per_day, temporal_summary, platform_length, platform_posts, iqr_outliers, short_long, length_examples,
        eda_summary, missing_values, duplicate_counts, date_span, day_extremes, coverage, engagement, merged_profiles, top_communities,
        distinct_communities, method_keyword_share, quality_scores, quality_verdict, recommendations,
        length_score_bins, length_score_corr, example_rows, detect_columns, detect_columns_by_length, preview,
        column_overview,
    )
}

_PATTERN = sql.quoted(tx.TOKEN_PATTERN)
_POST_COLUMNS = (
    "id", "text", "title", "selftext", "lang", "subreddit", "platform", "timestamp", "username", "score",
    "num_comments", "search_method", "quality", "toxic",
)


def _histogram(lengths):
    return f"""
    WITH l AS ({lengths}), m AS (SELECT min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM l)
    SELECT CAST(bin AS INTEGER) AS bin, round(low + (high - low) * bin / 50, 6) AS low,
      round(low + (high - low) * (bin + 1) / 50, 6) AS high, count(*) AS n
    FROM (SELECT *, CASE WHEN high = low THEN 0 ELSE least(floor((v - low) * 50 / (high - low)), 49) END AS bin FROM l, m)
    GROUP BY bin, low, high"""


def _terms(more=""):
    return f"""
    WITH w AS (SELECT unnest(regexp_extract_all(lower(text), {_PATTERN})) AS term FROM documents),
    c AS (SELECT term, count(*) AS n FROM w {more} GROUP BY term ORDER BY n DESC, term LIMIT 100)
    SELECT term, n, round(n::DOUBLE / (SELECT max(n) FROM c), 6) AS weight FROM c"""


_LABELLED_POSTS = "SELECT p.*, l.quality, l.toxic FROM posts p LEFT JOIN labels l ON l.doc_id = p.id"
_SCORES = f"""
    SELECT 'completeness' AS metric, (1.0::DOUBLE - ({' + '.join(f'count(*) FILTER ("{c}" IS NULL)' for c in _POST_COLUMNS)})
      / (count(*) * {len(_POST_COLUMNS)})::DOUBLE) * 100 AS score FROM whole
    UNION ALL SELECT 'content_richness', least(avg(length(text)) / 100, 100.0) FROM whole
    UNION ALL SELECT 'temporal_coverage',
      least(floor((floor(epoch(max("timestamp"))) - floor(epoch(min("timestamp")))) / 86400) / 30.0::DOUBLE * 100, 100.0) FROM whole
    UNION ALL SELECT 'engagement_diversity', least(stddev_samp(score) / 10, 100.0) FROM whole"""

SQL = {
    "describe_length": """SELECT count(length(text)) AS count, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std,
        CAST(min(length(text)) AS INTEGER) AS min, CAST(max(length(text)) AS INTEGER) AS max,
        round(quantile_cont(length(text), 0.25), 6) AS q25, round(quantile_cont(length(text), 0.5), 6) AS q50,
        round(quantile_cont(length(text), 0.75), 6) AS q75 FROM documents""",
    "hist_length": _histogram("SELECT length(text) AS v FROM documents"),
    "hist_cleaned_length": _histogram(f"SELECT length({sql.cleaned('text')}) AS v FROM documents"),
    "box_by_platform": sql.with_posts(
        """SELECT b.platform, n, CAST(min AS INTEGER) AS min, CAST(max AS INTEGER) AS max, round(q25, 6) AS q25, round(q50, 6) AS q50,
        round(q75, 6) AS q75, CAST(min(l.v) AS INTEGER) AS whisker_low, CAST(max(l.v) AS INTEGER) AS whisker_high
        FROM (SELECT platform, count(*) AS n, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25,
          quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM l GROUP BY platform) b
        JOIN l ON l.platform = b.platform AND l.v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)
        GROUP BY ALL""",
        l="SELECT platform, length(text) AS v FROM posts",
    ).replace("GROUP BY ALL", "GROUP BY b.platform, b.n, b.min, b.max, b.q25, b.q50, b.q75"),
    "term_top100": _terms(),
    "term_top_without_stop_words": _terms(
        f"""WHERE term NOT IN (SELECT term FROM (SELECT unnest(regexp_extract_all(lower(text), {_PATTERN})) AS term FROM benchmark)
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 10)"""
    ),
    "posts_per_day": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
    "temporal_summary": """SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days,
        round(count(*)::DOUBLE / count(DISTINCT CAST(ts AS DATE)), 6) AS posts_per_day FROM events""",
    "platform_length": sql.with_posts("SELECT platform, count(*) AS n, round(avg(length(text)), 6) AS avg_length FROM posts GROUP BY platform"),
    "platform_posts": sql.with_posts("SELECT platform, count(*) AS n FROM posts GROUP BY platform"),
    "iqr_outliers": f"""WITH l AS (SELECT length(text) AS v FROM documents),
        q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM l)
        SELECT round(a - 1.5 * (b - a), 6) AS low_fence, round(b + 1.5 * (b - a), 6) AS high_fence,
        count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers,
        {sql.percent('count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))', 'count(*)')} AS outlier_pct
        FROM l, q GROUP BY a, b""",
    "short_long": "SELECT count(*) FILTER (length(text) < 10) AS very_short, count(*) FILTER (length(text) > 1000) AS very_long FROM documents",
    "length_examples": """SELECT * FROM (SELECT 'short' AS kind, doc_id, CAST(length(text) AS INTEGER) AS length, substr(text, 1, 100) AS sample
          FROM documents WHERE length(text) < 10 ORDER BY doc_id LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 'long', doc_id, CAST(length(text) AS INTEGER), substr(text, 1, 100)
          FROM documents WHERE length(text) > 1000 ORDER BY doc_id LIMIT 2)""",
    "eda_summary": sql.with_posts(
        """SELECT count(*) AS total_posts, round(avg(length(text)), 6) AS avg_text_length,
        count(DISTINCT CAST("timestamp" AS DATE)) AS unique_dates, count(DISTINCT platform) AS platforms FROM posts"""
    ),
    "missing_values": sql.with_posts(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER ("{c}" IS NULL) AS missing,
            {sql.percent(f'count(*) FILTER ("{c}" IS NULL)', 'count(*)')} AS pct FROM whole"""
            for c in _POST_COLUMNS
        )
        + ") WHERE missing > 0",
        whole=_LABELLED_POSTS,
    ),
    "duplicate_counts": """
        SELECT 'rows' AS kind, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)
        UNION ALL SELECT 'id', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id)
        UNION ALL SELECT 'text', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
    "date_span": """SELECT min(ts) AS first, max(ts) AS last,
        CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS span_days FROM events""",
    "day_extremes": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median,
        (SELECT day FROM d ORDER BY n DESC, day LIMIT 1) AS busiest_day, (SELECT max(n) FROM d) AS busiest_n,
        (SELECT day FROM d ORDER BY n, day LIMIT 1) AS quietest_day, (SELECT min(n) FROM d) AS quietest_n FROM d""",
    "coverage": sql.with_posts(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} <> '') AS filled,
            {sql.percent(f"count(*) FILTER ({c} <> '')", 'count(*)')} AS pct,
            round(avg(length({c})) FILTER ({c} <> ''), 6) AS avg_length FROM posts"""
            for c in ("text", "title", "selftext")
        )
    ),
    "engagement": sql.with_posts(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5)::DOUBLE, 6) AS median,
            round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max FROM posts"""
            for c in ("score", "num_comments")
        )
    ),
    "merged_profiles": " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c})::DOUBLE, 6) AS low, round(max({c})::DOUBLE, 6) AS high, """
        + ", ".join(f"round(quantile_cont({c}, {q / 100})::DOUBLE, 6) AS q{q}" for q in (25, 50, 75)) + ", TRUE AS distinct_near, TRUE AS median_near FROM events"
        for name, c in (("amount", "value"), ("member", "user_id"))
    ),
    "detect_columns": """SELECT role, column_name, CAST(place AS INTEGER) AS place FROM (VALUES ('text', 'text', 0), ('text', 'title', 1), ('text', 'selftext', 2),
        ('date', 'timestamp', 0), ('platform', 'platform', 0)) AS v(role, column_name, place)""",
    "detect_columns_by_length": """SELECT 'text' AS role, name AS column_name, CAST(place AS INTEGER) AS place FROM (
          SELECT 'a' AS name, 0 AS place, avg(length(text)) AS mean FROM documents UNION ALL SELECT 'b', 1, avg(length(lang)) FROM documents
          UNION ALL SELECT 'source', 2, avg(length(source)) FROM documents) WHERE mean > 20
        UNION ALL SELECT 'platform', 'source', 0""",
    "top_communities": f"""SELECT source, n, {sql.percent('n', '(SELECT count(*) FROM documents)')} AS pct
        FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10)""",
    "distinct_communities": "SELECT count(DISTINCT source) AS communities FROM documents",
    "method_keyword_share": sql.with_posts(
        f"""SELECT kind, value, count(*) AS n, {sql.percent('count(*)', '(SELECT count(*) FROM posts)')} AS pct FROM (
          SELECT 'search_method' AS kind, search_method AS value FROM posts
          UNION ALL SELECT 'search_keyword', CASE """
        + " ".join(f"WHEN contains(lower(text), {sql.quoted(w)}) THEN {sql.quoted(w)}" for w in ip.KEYWORDS)
        + " END FROM posts) WHERE value IS NOT NULL GROUP BY kind, value"
    ),
    "quality_scores": sql.with_posts("SELECT metric, round(score, 6) AS score FROM scores", whole=_LABELLED_POSTS, scores=_SCORES),
    "quality_verdict": sql.with_posts(
        """SELECT metric, round(score, 6) AS score, CASE WHEN score > 70 THEN 'good' WHEN score > 40 THEN 'fair' ELSE 'poor' END AS status FROM scores
        UNION ALL SELECT 'overall', round(avg(score), 6), CASE WHEN avg(score) > 80 THEN 'EXCELLENT' WHEN avg(score) > 60 THEN 'GOOD'
          WHEN avg(score) > 40 THEN 'MODERATE' ELSE 'POOR' END FROM scores""",
        whole=_LABELLED_POSTS, scores=_SCORES,
    ),
    "recommendations": sql.with_posts(
        f"""SELECT advice FROM (
          SELECT CASE WHEN count(*) < 1000 THEN {sql.quoted(qu.ADVICE_POSTS)} END AS advice FROM posts
          UNION ALL SELECT CASE WHEN floor((epoch(max("timestamp")) - epoch(min("timestamp"))) / 86400) < 7 THEN {sql.quoted(qu.ADVICE_DAYS)} END FROM posts
          UNION ALL SELECT CASE WHEN count(*) > count(DISTINCT (text, lang, subreddit)) THEN {sql.quoted(qu.ADVICE_REPEATS)} END FROM posts
        ) WHERE advice IS NOT NULL"""
    ),
    "length_score_bins": sql.with_posts(
        f"""SELECT CAST(floor(length(text) / {LENGTH_WIDTH}) AS BIGINT) AS length_bin, CAST(floor(score / {SCORE_WIDTH}) AS BIGINT) AS score_bin,
        count(*) AS n FROM posts GROUP BY 1, 2"""
    ),
    "length_score_corr": sql.with_posts("SELECT round(corr(length(text), score), 6) AS correlation FROM posts"),
    "example_rows": f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS length,
        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS sample
        FROM documents ORDER BY {sql.draw('doc_id')}, doc_id LIMIT 3""",
    "preview": "SELECT * FROM documents ORDER BY doc_id LIMIT 5",
    "column_overview": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM documents"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
}
