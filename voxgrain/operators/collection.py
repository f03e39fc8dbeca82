"""Selection of posts from a landed submissions table: search, quotas, top-up, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.functions.privacy import author_or_deleted, short_hash
from voxgrain.functions.stats import ratio
from voxgrain.operators.ranking import exact_quantiles, first_per_key, keep_top
from voxgrain.sources.files import materialize
from voxgrain.sources.topic import SEARCH_HOURS, TOP_UP_SCAN, Topic

# Weights of the relevance score, days until a post counts as old, tags of
# topped-up posts, and the start of post addresses.
SCORE_WEIGHT = 0.4
COMMENTS_WEIGHT = 0.3
RECENCY_WEIGHT = 0.3
RECENCY_DAYS = 30
TOP_UP_METHOD = "hot_general"
TOP_UP_KEYWORD = "general"
POST_URL_PREFIX = "https://reddit.com"
SECONDS_PER_DAY = 86400

# Found posts are sent to all tasks up to this many rows of a key, names and places.
BROADCAST_ROWS = 200_000

PICK_ORDER = ("method_place", "keyword_place", "rank")


def landed_posts(submissions: DataFrame, collected_at: Column, platform: str = "reddit") -> DataFrame:
    """Shape landed submissions (id, title, selftext, created_utc, author, ...) as posts."""
    return submissions.select(
        F.lit(platform).alias("platform"),
        F.col("id").cast("string").alias("id"),
        tx.full_text("title", "selftext").alias("text"),
        "title",
        "selftext",
        F.timestamp_seconds("created_utc").alias("timestamp"),
        short_hash("author").alias("user_hash"),
        author_or_deleted("author").alias("username"),
        "score",
        "upvote_ratio",
        "num_comments",
        "subreddit",
        F.concat(F.lit(POST_URL_PREFIX), F.col("permalink")).alias("url"),
        collected_at.alias("collected_at"),
    )


def per_community(topic: Topic, number: Callable[[str], int], community: str = "subreddit") -> Column:
    """A number known per community, as a Column."""
    value = F.lit(None).cast("int")
    for name in reversed(topic.communities):
        value = F.when(F.col(community) == name, F.lit(number(name))).otherwise(value)
    return value


def passes_filters(topic: Topic, language_ok: Column | None = None) -> Column:
    """Length and score bounds, and the language test in the communities that need it."""
    kept = tx.length_between("text", topic.min_length, topic.max_length) & (F.col("score") >= topic.min_score)
    if language_ok is None:
        return kept
    return kept & (~F.col("subreddit").isin(*topic.language_tested) | F.coalesce(language_ok, F.lit(False)))


def in_communities(df: DataFrame, topic: Topic) -> DataFrame:
    return df.where(F.col("subreddit").isin(*topic.communities))


def hot_rank(score: Column, timestamp: Column) -> Column:
    """Votes on a log scale plus age, the public formula of hot listings."""
    votes = F.signum(score) * F.log10(F.greatest(F.abs(score), F.lit(1.0)))
    return F.round(votes + epoch(timestamp) / F.lit(45000.0), 6)


def epoch(timestamp: Column) -> Column:
    """Whole seconds since 1970, for timestamps with or without zone."""
    return F.unix_timestamp(timestamp.cast("timestamp"))


def within_time(timestamp: Column, topic: Topic, as_of: Column) -> Column:
    """Whether a post is recent enough for the topic's searches at a time."""
    hours = SEARCH_HOURS[topic.time_filter]
    return F.lit(True) if hours is None else epoch(timestamp) >= epoch(as_of) - hours * 3600


def sent_whole(keys: DataFrame, most: int) -> DataFrame:
    """A table of at most ``most`` rows, broadcast if that is few enough."""
    return F.broadcast(keys) if most <= BROADCAST_ROWS else keys


def search_candidates(df: DataFrame, topic: Topic, as_of: Column | None = None) -> DataFrame:
    """What the searches return: one row per post, method and matching keyword.

    ``as_of`` is the time of the search: older posts than the topic's time filter lets
    through are not found. Without it posts of any age are.

    Each search in a community is cut to its own limit: ``top`` by score, ``new`` by time,
    ``hot`` by hot rank and any other method by how often the keyword occurs. Only keys
    and ranks are fanned out, never texts, and only for keywords that match.
    """
    if as_of is not None:
        df = df.where(within_time(F.col("timestamp"), topic, as_of))
    keywords = F.array(
        *[
            F.when(tx.has_keyword("text", [word]), F.struct(F.lit(i).alias("place"), F.lit(word).alias("word"),
                   tx.occurrences("text", F.lit(word)).alias("times")))
            for i, word in enumerate(topic.keywords)
        ]
    )
    methods = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("name")) for i, m in enumerate(topic.methods)])
    matched = (
        in_communities(df, topic)
        .select(
            "id", "subreddit", "score", epoch(F.col("timestamp")).alias("_seconds"),
            hot_rank(F.col("score"), F.col("timestamp")).alias("_hot"),
            F.explode(F.array_compact(keywords)).alias("_keyword"),
        )
        .withColumn("_method", F.explode(methods))
    )
    method = F.col("_method.name")
    weight = (
        F.when(method == "top", F.col("score").cast("double"))
        .when(method == "new", F.col("_seconds").cast("double"))
        .when(method == "hot", F.col("_hot"))
        .otherwise(F.col("_keyword.times").cast("double"))
    )
    fanned = matched.select(
        "id", "subreddit", "score",
        method.alias("search_method"), F.col("_method.place").alias("method_place"),
        F.col("_keyword.word").alias("search_keyword"), F.col("_keyword.place").alias("keyword_place"),
        weight.alias("_weight"),
    )
    limits = per_community(topic, topic.per_search)
    bound = max(topic.per_search(name) for name in topic.communities)
    ranked = keep_top(
        fanned, ["subreddit", "method_place", "keyword_place"],
        [F.desc("_weight"), F.desc("score"), F.asc("id")], limits, "id", bound,
    )
    return ranked.drop("_weight", "score")


def first_seen(candidates: DataFrame, by: tuple[str, ...] = ("subreddit", "id")) -> DataFrame:
    """The first candidate row of each post in search order."""
    return first_per_key(candidates, by, [F.col(name) for name in PICK_ORDER])


def within_quota(seen: DataFrame, posts: DataFrame, topic: Topic, language_ok: Column | None = None) -> DataFrame:
    """Join first-seen candidates with their posts, filter, and keep each community's quota.

    ``seen`` holds no more than the search limits allow. If that is few enough it goes to
    the posts, and texts move only for posts that are in it.
    """
    kept = posts.where(passes_filters(topic, language_ok))
    picked = kept.join(sent_whole(seen, topic.most_found()), ["id", "subreddit"])
    bound = max(topic.quota(name) for name in topic.communities)
    order = [F.col(name) for name in PICK_ORDER] + [F.col("id")]
    return keep_top(picked, ["subreddit"], order, per_community(topic, topic.quota), "id", bound, rank="place")


def top_up(selected: DataFrame, candidates: DataFrame, posts: DataFrame, topic: Topic) -> DataFrame:
    """Posts that fill communities below their quota.

    The hottest min(missing, 100) posts of such a community are looked at; those not
    examined before that hold a keyword and are long enough are taken. The maximum
    length, score and language tests do not apply here.
    """
    have = selected.groupBy("subreddit").agg(F.count(F.lit(1)).alias("_have"))
    hottest = keep_top(
        in_communities(posts, topic).select(
            "id", "subreddit", hot_rank(F.col("score"), F.col("timestamp")).alias("_hot")
        ),
        ["subreddit"], [F.desc("_hot"), F.asc("id")], TOP_UP_SCAN, "id",
    )
    missing = per_community(topic, topic.quota) - F.coalesce("_have", F.lit(0))
    looked_at = (
        hottest.join(have, "subreddit", "left")
        .where(F.col("rank") <= missing)
        .join(sent_whole(candidates.select("id", "subreddit").distinct(), topic.most_found()), ["id", "subreddit"], "left_anti")
        .select("id", "subreddit", "rank")
    )
    fits = tx.has_keyword("text", topic.keywords) & (F.length("text") >= topic.min_length)
    return (
        posts.where(fits)
        .join(sent_whole(looked_at, TOP_UP_SCAN * len(topic.communities)), ["id", "subreddit"])
        .withColumn("search_method", F.lit(TOP_UP_METHOD))
        .withColumn("search_keyword", F.lit(TOP_UP_KEYWORD))
    )


def first_across_communities(df: DataFrame, topic: Topic, order: list[str]) -> DataFrame:
    """One row per post id: the first in community order, then in the given order."""
    place = per_community(topic, topic.communities.index)
    ordered = df.withColumn("_community", place)
    return first_per_key(ordered, ["id"], [F.col("_community"), *[F.col(c) for c in order]]).drop("_community")


def with_relevance(df: DataFrame, as_of: Column) -> DataFrame:
    """Add ``relevance``: score and comments against their maxima, and recency.

    The maxima are computed once as a scalar subquery. A maximum of 0 gives 0.
    """
    maxima = df.select(F.struct(F.max("score").alias("score"), F.max("num_comments").alias("comments"))).scalar()
    score = ratio(F.col("score").cast("double"), maxima.getField("score").cast("double"))
    comments = ratio(F.col("num_comments").cast("double"), maxima.getField("comments").cast("double"))
    days = F.floor((epoch(as_of) - epoch(F.col("timestamp"))) / SECONDS_PER_DAY)
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(float(RECENCY_DAYS)))
    return df.withColumn(
        "relevance",
        SCORE_WEIGHT * F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
        + COMMENTS_WEIGHT * F.least(F.lit(1.0), comments)
        + RECENCY_WEIGHT * recency,
    )


def most_relevant(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The ``limit`` most relevant rows; ties by key."""
    return df.orderBy(F.desc(F.round("relevance", 12)), key).limit(limit)


def collect_posts(posts: DataFrame, topic: Topic, as_of: Column, language_ok: Column | None = None) -> DataFrame:
    """The whole selection: search, quota, top-up, repeats, relevance, limit.

    Candidates and selected posts are used several times. The search limits and quotas
    bound them, so they are computed once and written, instead of searching all texts
    again for every use.
    """
    candidates = materialize(search_candidates(posts, topic, as_of))
    selected = materialize(within_quota(first_seen(candidates), posts, topic, language_ok))
    added = top_up(selected, candidates, posts, topic)
    shape = [*posts.columns, "search_method", "search_keyword", "rank"]
    first = selected.select(*posts.columns, "search_method", "search_keyword", F.col("place").alias("rank"))
    first = first.withColumn("_topped", F.lit(0))
    added = added.select(*shape).withColumn("_topped", F.lit(1))
    unique = first_across_communities(first.unionByName(added), topic, ["_topped", "rank"])
    return most_relevant(with_relevance(unique.drop("_topped", "rank"), as_of), topic.limit)


def community_counts(df: DataFrame, community: str = "subreddit") -> DataFrame:
    return df.groupBy(community).agg(F.count(F.lit(1)).alias("n"))


def collection_stats(df: DataFrame) -> DataFrame:
    """One row: posts, distinct users, means, time range, and score range with median."""
    users = df.where(F.col("user_hash").isNotNull()).groupBy("user_hash").agg(F.count(F.lit(1)).alias("_n"))
    median = exact_quantiles(df, "score", [0.5])
    return df.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.avg("score").alias("avg_score"),
        F.avg("num_comments").alias("avg_comments"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    ).select(
        "*",
        users.select(F.count(F.lit(1))).scalar().alias("unique_users"),
        median.select("q50").scalar().alias("median_score"),
    )
