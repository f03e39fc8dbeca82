"""Registered queries: selecting posts from a landed submissions table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.functions.privacy import short_hash
from voxgrain.operators import collection as col
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql

TOPIC = ip.TOPIC
LONG_WORD = 6
_as_of = lambda: F.lit(ip.AS_OF).cast("timestamp_ntz")
_wanted = lambda: F.col("lang") == TOPIC.language


def full_text(spark, sf_dir):
    return ip.posts(spark, sf_dir).select("id", tx.full_text("title", "selftext").alias("full_text"))


def landed_posts(spark, sf_dir):
    """Submissions with epoch times, missing authors and relative addresses become posts."""
    df = ip.posts(spark, sf_dir)
    pages = ip.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://[^/]*(.*)$", 1).alias("permalink")
    )
    author = F.when(F.col("search_method") != "error", F.col("username"))
    submissions = df.join(pages, "id", "left").select(
        "id", "title", "selftext", col.epoch(F.col("timestamp")).alias("created_utc"), author.alias("author"), "score",
        F.lit(None).cast("double").alias("upvote_ratio"), "num_comments", "subreddit", "permalink",
    )
    landed = col.landed_posts(submissions, F.lit(ip.AS_OF).cast("timestamp_ntz"))
    return landed.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def keyword_match(spark, sf_dir):
    matched = ip.text_posts(spark, sf_dir).where(tx.has_keyword("text", TOPIC.keywords))
    return matched.select("id", F.array_join(tx.matched_keywords("text", TOPIC.keywords), ",").alias("keywords"))


def collect_filters(spark, sf_dir):
    df = col.in_communities(ip.posts(spark, sf_dir), TOPIC).where(col.passes_filters(TOPIC, _wanted()))
    return df.select("id", "subreddit", "score", "lang")


def candidate_fanout(spark, sf_dir):
    found = col.search_candidates(ip.text_posts(spark, sf_dir), TOPIC)
    return found.select("id", "subreddit", "search_method", "search_keyword", "rank")


def collect_time_filter(spark, sf_dir):
    """The searches of the last week only."""
    topic = replace(TOPIC, time_filter="week")
    found = col.search_candidates(ip.text_posts(spark, sf_dir), topic, _as_of())
    return found.select("id", "subreddit", "search_method", "search_keyword", "rank")


def dedup_first_seen(spark, sf_dir):
    found = col.first_seen(col.search_candidates(ip.text_posts(spark, sf_dir), TOPIC))
    return found.select("id", "subreddit", "search_method", "search_keyword", "rank")


def _selected(spark, sf_dir):
    df = ip.text_posts(spark, sf_dir).drop("search_method")
    candidates = col.search_candidates(df, TOPIC)
    return df, candidates, col.within_quota(col.first_seen(candidates), df, TOPIC, _wanted())


def quota_select(spark, sf_dir):
    return _selected(spark, sf_dir)[2].select("id", "subreddit", "search_method", "search_keyword", "place")


def hot_topup(spark, sf_dir):
    df, candidates, selected = _selected(spark, sf_dir)
    added = col.top_up(selected, candidates, df, TOPIC)
    return added.select("id", "subreddit", "rank", "search_method", "search_keyword")


def collected_posts(spark, sf_dir):
    """The whole selection from search to relevance limit."""
    df = ip.text_posts(spark, sf_dir).drop("search_method")
    found = col.collect_posts(df, TOPIC, _as_of(), _wanted())
    return ip.rounded(found.select("id", "subreddit", "search_method", "search_keyword", "relevance"))


def relevance_topk(spark, sf_dir):
    scored = col.with_relevance(ip.posts(spark, sf_dir).drop("text", "title", "selftext"), _as_of())
    return ip.rounded(col.most_relevant(scored, TOPIC.limit).select("id", "subreddit", "relevance"))


def collection_stats(spark, sf_dir):
    df = ip.posts(spark, sf_dir).withColumn("user_hash", short_hash("username"))
    return ip.rounded(col.collection_stats(df))


def community_distribution(spark, sf_dir):
    return col.community_counts(ip.table(spark, sf_dir, "documents"), "source")


def word_list(spark, sf_dir):
    """How many of some hundred words or more stand in each document: all longer words of the benchmark passages."""
    words = ip.table(spark, sf_dir, "benchmark").select(F.explode(F.split(tx.clean_text("text"), " ")).alias("word"))
    longer = [r["word"] for r in words.where(F.length("word") >= LONG_WORD).distinct().orderBy("word").collect()]
    found = F.size(tx.matched_keywords("text", longer))
    return ip.documents(spark, sf_dir).select("doc_id", found.alias("found"))


QUERIES = {
    f.__name__: f
    for f in (
        full_text, landed_posts, keyword_match, collect_filters, candidate_fanout, collect_time_filter, dedup_first_seen,
        quota_select, hot_topup, collected_posts, relevance_topk, collection_stats, community_distribution,
        word_list,
    )
}

_HAS = lambda text, word: f"contains(lower({text}), {sql.quoted(word.lower())})"
_ANY = " OR ".join(_HAS("text", word) for word in TOPIC.keywords)
_IN = ", ".join(sql.quoted(name) for name in TOPIC.communities)
_TESTED = ", ".join(sql.quoted(name) for name in TOPIC.language_tested)
_FILTERS = (
    f"length(text) BETWEEN {TOPIC.min_length} AND {TOPIC.max_length} AND score >= {TOPIC.min_score} "
    f"AND (subreddit NOT IN ({_TESTED}) OR lang = '{TOPIC.language}')"
)
_HOT = 'round(sign(score) * log10(greatest(abs(score), 1.0)) + floor(epoch("timestamp")) / 45000.0, 6)'
_KEYWORDS = ", ".join(f"({sql.quoted(word)}, {i})" for i, word in enumerate(TOPIC.keywords))
_METHODS = ", ".join(f"({sql.quoted(name)}, {i})" for i, name in enumerate(TOPIC.methods))
_SETTINGS = ", ".join(
    f"({sql.quoted(name)}, {i}, {TOPIC.quota(name)}, {TOPIC.per_search(name)})" for i, name in enumerate(TOPIC.communities)
)

_SEARCHED = {
    "settings": f"SELECT * FROM (VALUES {_SETTINGS}) AS s(subreddit, community_place, quota, per_search)",
    "fanned": f"""
        SELECT p.id, p.subreddit, p.score, m.name AS search_method, m.place AS method_place,
          k.word AS search_keyword, k.place AS keyword_place,
          CASE m.name WHEN 'top' THEN score WHEN 'new' THEN floor(epoch(p."timestamp")) WHEN 'hot' THEN {_HOT}
            ELSE (length(lower(p.text)) - length(replace(lower(p.text), lower(k.word), ''))) // length(k.word) END AS weight
        FROM posts p JOIN (VALUES {_KEYWORDS}) AS k(word, place) ON contains(lower(p.text), lower(k.word)),
          (VALUES {_METHODS}) AS m(name, place)
        WHERE p.subreddit IN ({_IN})""",
    "candidates": """
        SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, method_place, keyword_place
          ORDER BY weight DESC, score DESC, id) AS rank FROM fanned) f
        JOIN settings s ON s.subreddit = f.subreddit WHERE f.rank <= s.per_search""",
    "seen": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, id
          ORDER BY method_place, keyword_place, rank) AS turn FROM candidates) WHERE turn = 1""",
    "selected": f"""
        SELECT q.* FROM (
          SELECT p.id, p.subreddit, s.found_by AS search_method, s.search_keyword,
            row_number() OVER (PARTITION BY p.subreddit ORDER BY s.method_place, s.keyword_place, s.rank, p.id) AS place
          FROM (SELECT * FROM posts WHERE {_FILTERS}) p
          JOIN (SELECT * EXCLUDE (search_method), search_method AS found_by FROM seen) s ON s.id = p.id AND s.subreddit = p.subreddit) q
        JOIN settings t ON t.subreddit = q.subreddit WHERE q.place <= t.quota""",
    "hottest": f"""
        SELECT * FROM (SELECT id, subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY {_HOT} DESC, id) AS rank
          FROM posts WHERE subreddit IN ({_IN})) WHERE rank <= 100""",
    "added": f"""
        SELECT h.id, h.subreddit, h.rank FROM hottest h JOIN settings s ON s.subreddit = h.subreddit
          LEFT JOIN (SELECT subreddit, count(*) AS n FROM selected GROUP BY subreddit) c ON c.subreddit = h.subreddit
          JOIN posts p ON p.id = h.id
        WHERE h.rank <= s.quota - coalesce(c.n, 0)
          AND NOT EXISTS (SELECT 1 FROM candidates x WHERE x.id = h.id AND x.subreddit = h.subreddit)
          AND ({_ANY}) AND length(p.text) >= {TOPIC.min_length}""",
}


def _until(last):
    names = list(_SEARCHED)
    return {name: _SEARCHED[name] for name in names[: names.index(last) + 1]}


def _with(query, last):
    return sql.with_posts(query, **_until(last))


def _relevance(source):
    return f"""SELECT x.*, 0.4 * least(1.0, greatest(0.0, CASE WHEN ms = 0 THEN 0.0 ELSE score::DOUBLE / ms END))
        + 0.3 * least(1.0, CASE WHEN mc = 0 THEN 0.0 ELSE num_comments::DOUBLE / mc END)
        + 0.3 * greatest(0.0, 1.0 - floor((epoch(TIMESTAMP '{ip.AS_OF}') - floor(epoch("timestamp"))) / 86400) / 30.0::DOUBLE) AS relevance
        FROM {source} x, (SELECT max(score) AS ms, max(num_comments) AS mc FROM {source})"""


SQL = {
    "word_list": f"""WITH words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split({sql.cleaned('text')}, ' ')) AS word FROM benchmark) WHERE length(word) >= {LONG_WORD})
        SELECT doc_id, CAST(count(*) FILTER (contains(lower(text), word)) AS INTEGER) AS found FROM documents, words GROUP BY doc_id""",
    "full_text": sql.with_posts(
        "SELECT id, CASE WHEN selftext <> '' THEN title || ' ' || selftext ELSE title END AS full_text FROM posts"
    ),
    "landed_posts": sql.with_posts(
        f"""SELECT 'reddit' AS platform, p.id::VARCHAR AS id,
        CASE WHEN selftext <> '' THEN title || ' ' || selftext ELSE title END AS text, title, selftext,
        date_trunc('second', p."timestamp") AS "timestamp",
        substr(sha256(CASE WHEN search_method <> 'error' THEN username ELSE 'deleted' END), 1, 12) AS user_hash,
        CASE WHEN search_method <> 'error' THEN username ELSE 'deleted' END AS username,
        score, CAST(NULL AS DOUBLE) AS upvote_ratio, num_comments, subreddit,
        'https://reddit.com' || regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS url,
        TIMESTAMP '{ip.AS_OF}' AS collected_at FROM posts p LEFT JOIN pages g ON g.page_id = p.id"""
    ),
    "keyword_match": sql.with_posts(
        "SELECT id, concat_ws(',', "
        + ", ".join(f"CASE WHEN {_HAS('text', w)} THEN {sql.quoted(w)} END" for w in TOPIC.keywords)
        + f") AS keywords FROM posts WHERE {_ANY}"
    ),
    "collect_filters": sql.with_posts(f"SELECT id, subreddit, score, lang FROM posts WHERE subreddit IN ({_IN}) AND {_FILTERS}"),
    "candidate_fanout": _with("SELECT id, subreddit, search_method, search_keyword, CAST(rank AS INTEGER) AS rank FROM candidates", "candidates"),
    "collect_time_filter": sql.with_named(
        "SELECT id, subreddit, search_method, search_keyword, CAST(rank AS INTEGER) AS rank FROM candidates",
        posts=f"""SELECT * FROM ({sql.POSTS}) WHERE "timestamp" >= TIMESTAMP '{ip.AS_OF}' - INTERVAL 7 DAY""",
        **_until("candidates"),
    ),
    "dedup_first_seen": _with("SELECT id, subreddit, search_method, search_keyword, CAST(rank AS INTEGER) AS rank FROM seen", "seen"),
    "quota_select": _with("SELECT id, subreddit, search_method, search_keyword, CAST(place AS INTEGER) AS place FROM selected", "selected"),
    "hot_topup": _with(
        "SELECT id, subreddit, CAST(rank AS INTEGER) AS rank, 'hot_general' AS search_method, 'general' AS search_keyword FROM added", "added"
    ),
    "collected_posts": sql.with_posts(
        f"""SELECT id, subreddit, search_method, search_keyword, round(relevance, 6) AS relevance FROM relevant
        ORDER BY round(relevance, 12) DESC, id LIMIT {TOPIC.limit}""",
        **_SEARCHED,
        picked="""SELECT id, subreddit, search_method, search_keyword, 0 AS topped, place AS rank FROM selected
            UNION ALL SELECT id, subreddit, 'hot_general', 'general', 1, rank FROM added""",
        once="""SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY s.community_place, topped, rank) AS turn
            FROM picked p JOIN settings s ON s.subreddit = p.subreddit) WHERE turn = 1""",
        whole="""SELECT o.id, o.subreddit, o.search_method, o.search_keyword, p.score, p.num_comments, p."timestamp"
            FROM once o JOIN posts p ON p.id = o.id""",
        relevant=_relevance("whole"),
    ),
    "relevance_topk": sql.with_posts(
        f"""SELECT id, subreddit, round(relevance, 6) AS relevance FROM relevant
        ORDER BY round(relevance, 12) DESC, id LIMIT {TOPIC.limit}""",
        relevant=_relevance("posts"),
    ),
    "collection_stats": sql.with_posts(
        """SELECT count(*) AS total_posts, round(avg(score), 6) AS avg_score, round(avg(num_comments), 6) AS avg_comments,
        min("timestamp") AS "start", max("timestamp") AS "end", round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
        count(DISTINCT username) AS unique_users, round(quantile_cont(score, 0.5), 6) AS median_score FROM posts"""
    ),
    "community_distribution": "SELECT source, count(*) AS n FROM documents GROUP BY source",
}
