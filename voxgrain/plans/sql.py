"""Fragments of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from voxgrain.functions import text as tx
from voxgrain.plans import inputs as ip


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(expression: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expression}, {quoted(pattern)}, {quoted(by)}, 'g')"


def cleaned(expression: str) -> str:
    value = f"lower(coalesce({expression}, ''))"
    for pattern in (tx.URL_PATTERN, tx.MENTION_PATTERN, tx.HASHTAG_PATTERN):
        value = replaced(value, pattern)
    value = replaced(value, tx.NON_WORD_PATTERN, " ")
    return f"trim({replaced(value, tx.SPACES_PATTERN, ' ')})"


def draw(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def word_hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({text}), {quoted(w)})::INTEGER" for w in words) + ")"


def weak_label(text: str, key: str, good=ip.GOOD_WORDS, bad=ip.BAD_WORDS) -> str:
    g, b = word_hits(text, good), word_hits(text, bad)
    return (
        f"CASE WHEN {g} > {b} THEN 'positive' WHEN {b} > {g} THEN 'negative' "
        f"WHEN {draw(key)} < 2576980378 THEN 'neutral' WHEN {draw(key)} < 3435973837 THEN 'positive' ELSE 'negative' END"
    )


POSTS = """
SELECT d.doc_id AS id, d.text,
  split_part(d.text, chr(10), 1) AS title,
  CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS selftext,
  d.lang, d.source AS subreddit,
  CASE WHEN d.doc_id % 3 = 0 THEN 'twitter' ELSE 'reddit' END AS platform,
  e.ts AS "timestamp", 'u' || e.user_id AS username, e.value + 0.0 AS score,
  CAST(regexp_extract(e.props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS num_comments,
  e.event_type AS search_method
FROM documents d JOIN events e ON e.event_id = d.doc_id
"""

SCORED = f"""
SELECT *, {weak_label('text', 'id')} AS predicted_sentiment,
  (greatest({word_hits('text', ip.GOOD_WORDS)}, {word_hits('text', ip.BAD_WORDS)}) + 1.0::DOUBLE)
    / ({word_hits('text', ip.GOOD_WORDS)} + {word_hits('text', ip.BAD_WORDS)} + 3.0::DOUBLE) AS confidence
FROM posts
"""

LABELLED = f"""
SELECT d.doc_id AS id, {cleaned('d.text')} AS text,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
"""


def with_posts(query: str, **more: str) -> str:
    """The query over a ``posts`` table and further named ones."""
    named = {"posts": POSTS, **more}
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in named.items()) + "\n" + query


def with_scored(query: str, **more: str) -> str:
    return with_posts(query, scored=SCORED, **more)


def with_named(query: str, **named: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in named.items()) + "\n" + query


def percent(part: str, whole: str, digits: int = 4) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE round(({part}) * 100.0::DOUBLE / ({whole}), {digits}) END"


def tenths(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE ((({part}) * 2000 + ({whole})) // (({whole}) * 2)) / 10.0::DOUBLE END"
