"""Registered queries: cleaning, validity, repeats and lemmas."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.operators import cleaning as cl
from voxgrain.operators import lemmas as lm
from voxgrain.operators.lemmas import lemmatize
from voxgrain.operators.profiling import count_by
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql

_wanted = lambda: F.col("lang") == ip.TARGET_LANGUAGE


def _processed(spark, sf_dir, **options):
    return cl.process_posts(
        ip.text_posts(spark, sf_dir), min_length=ip.MIN_LENGTH, max_length=ip.MAX_LENGTH,
        language_ok=_wanted(), lexicon=ip.LEXICON, **options,
    )


def clean_text(spark, sf_dir):
    return ip.documents(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("cleaned"))


def clean_pages(spark, sf_dir):
    """Web addresses inside text: each removal on its own and all together."""
    line = F.concat(F.lit("Veja "), F.col("url"), F.lit(" @ana_é #tópico "), F.col("html"))
    return ip.table(spark, sf_dir, "pages").select(
        "page_id",
        tx.remove_urls(line).alias("no_urls"),
        tx.remove_mentions(line).alias("no_mentions"),
        tx.remove_hashtags(line).alias("no_hashtags"),
        tx.squeeze_spaces(line).alias("squeezed"),
        tx.clean_text(line).alias("cleaned"),
    )


def clean_valid(spark, sf_dir):
    return _processed(spark, sf_dir).select("id", "cleaned", "lemmatized", "is_valid", "length")


def valid_modes(spark, sf_dir):
    """Validity with the language test, without it, and without it but strict."""
    df = ip.text_posts(spark, sf_dir).withColumn("cleaned", tx.clean_text("text"))
    cleaned = F.col("cleaned")
    bounds = (ip.MIN_LENGTH, ip.MAX_LENGTH)
    return df.select(
        "id",
        cl.validity(cleaned, *bounds, language_ok=_wanted()).alias("with_language"),
        cl.validity(cleaned, *bounds).alias("without_language"),
        cl.validity(cleaned, *bounds, strict=True).alias("strict"),
    )


def clean_stats(spark, sf_dir):
    return ip.rounded(cl.processing_stats(_processed(spark, sf_dir, keep_invalid=True), _wanted()))


def clean_before_after(spark, sf_dir):
    return ip.rounded(cl.before_after(_processed(spark, sf_dir, keep_invalid=True)))


def dedup_lemmatized(spark, sf_dir):
    return cl.drop_repeats(_processed(spark, sf_dir)).select("id", "lemmatized")


def dedup_counts(spark, sf_dir):
    return cl.repeat_counts(_processed(spark, sf_dir))


def platform_counts(spark, sf_dir):
    return count_by(cl.drop_repeats(_processed(spark, sf_dir)), "platform")


def nonempty_text(spark, sf_dir):
    return cl.filled_only(ip.posts(spark, sf_dir), "selftext").select("id", "selftext")


def lemma_lexicon(spark, sf_dir):
    """The same lexicon as an expression and as a table give one result."""
    df = ip.documents(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("cleaned"))
    table = spark.createDataFrame(list(ip.LEXICON.items()), "form string, lemma string")
    joined = lemmatize(df, "cleaned", "lemmatized", "doc_id", table)
    return lemmatize(joined, "cleaned", "by_expression", "doc_id", ip.LEXICON).select("doc_id", "lemmatized", "by_expression")


# A lexicon from the given texts: their words, most without a usual ending, some as they are.
ENDINGS = "(ungen|ing|en|ed|es|s)$"
LONG_WORD = 5


def _word_lexicon(spark, sf_dir):
    words = ip.table(spark, sf_dir, "benchmark").select(F.explode(F.split(tx.clean_text("text"), " ")).alias("form")).where("form <> ''").distinct()
    regular = (F.length("form") >= LONG_WORD) & (F.length("form") % 7 != 0)
    return words.select("form", F.when(regular, F.regexp_replace("form", ENDINGS, "")).otherwise(F.col("form")).alias("lemma"))


def lemma_rules(spark, sf_dir):
    return lm.ending_rules(_word_lexicon(spark, sf_dir))


def lemma_by_rule(spark, sf_dir):
    """The lexicon with the lemmas of all further words of the documents that have a known ending."""
    lexicon = _word_lexicon(spark, sf_dir)
    texts = ip.documents(spark, sf_dir).select(tx.clean_text("text").alias("text"))
    return lm.completed(texts, "text", lexicon, lm.ending_rules(lexicon))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, clean_pages, clean_valid, valid_modes, clean_stats, clean_before_after,
        dedup_lemmatized, dedup_counts, platform_counts, nonempty_text, lemma_lexicon, lemma_rules, lemma_by_rule,
    )
}

_RULES = {
    "lexicon": f"""SELECT form, CASE WHEN length(form) >= {LONG_WORD} AND length(form) % 7 <> 0 THEN regexp_replace(form, '{ENDINGS}', '') ELSE form END AS lemma FROM (
        SELECT DISTINCT unnest(string_split({sql.cleaned('text')}, ' ')) AS form FROM benchmark) WHERE form <> ''""",
    "changes": """SELECT form, length(form) - same AS cut, substr(lemma, same + 1) AS put FROM (
        SELECT form, lemma, list_max(list_filter(range(0, least(length(form), length(lemma)) + 1), lambda i: substr(form, 1, i) = substr(lemma, 1, i))) AS same FROM lexicon)""",
    "endings": f"""SELECT cut, put, right(form, n) AS ending FROM (
        SELECT *, unnest(range(greatest(cut, 1), least({lm.LONGEST_ENDING}, length(form) - 1) + 1)) AS n FROM changes)""",
    "rules": f"""SELECT ending, CAST(cut AS INTEGER) AS cut, put, forms FROM (
        SELECT *, row_number() OVER (PARTITION BY ending ORDER BY forms DESC, cut, put) AS place
        FROM (SELECT ending, cut, put, count(*) AS forms FROM endings GROUP BY ALL) WHERE forms >= {lm.MIN_FORMS}) WHERE place = 1""",
}
_LEX = ", ".join(f"({sql.quoted(a)}, {sql.quoted(b)})" for a, b in ip.LEXICON.items())
_LEMMA = f"""
SELECT t.id, string_agg(coalesce(x.lemma, t.word), ' ' ORDER BY t.at) AS lemmatized
FROM (SELECT id, unnest(string_split(cleaned, ' ')) AS word, generate_subscripts(string_split(cleaned, ' '), 1) AS at
      FROM marked) t
LEFT JOIN (VALUES {_LEX}) AS x(form, lemma) ON x.form = t.word GROUP BY t.id
"""
_MARKED = f"""
SELECT *, coalesce(length(cleaned) BETWEEN {ip.MIN_LENGTH} AND {ip.MAX_LENGTH} AND lang = '{ip.TARGET_LANGUAGE}', FALSE) AS is_valid
FROM (SELECT *, {sql.cleaned('text')} AS cleaned FROM posts)
"""
_PROCESSED = """
SELECT m.*, CASE WHEN m.is_valid THEN l.lemmatized ELSE '' END AS lemmatized
FROM marked m LEFT JOIN lemmas l ON l.id = m.id
"""


def _with_processed(query):
    return sql.with_posts(query, marked=_MARKED, lemmas=_LEMMA, processed=_PROCESSED)


_PAGE = "'Veja ' || url || ' @ana_é #tópico ' || html"

SQL = {
    "clean_text": f"SELECT doc_id, {sql.cleaned('text')} AS cleaned FROM documents",
    "clean_pages": f"""SELECT page_id, {sql.replaced(_PAGE, tx.URL_PATTERN)} AS no_urls,
        {sql.replaced(_PAGE, tx.MENTION_PATTERN)} AS no_mentions, {sql.replaced(_PAGE, tx.HASHTAG_PATTERN)} AS no_hashtags,
        trim({sql.replaced(_PAGE, tx.SPACES_PATTERN, ' ')}) AS squeezed, {sql.cleaned(_PAGE)} AS cleaned FROM pages""",
    "clean_valid": _with_processed(
        "SELECT id, cleaned, lemmatized, is_valid, CAST(length(cleaned) AS INTEGER) AS length FROM processed WHERE is_valid"
    ),
    "valid_modes": sql.with_posts(
        f"""SELECT id, is_valid AS with_language, TRUE AS without_language,
        length(cleaned) BETWEEN {ip.MIN_LENGTH} AND {ip.MAX_LENGTH} AS strict FROM marked""", marked=_MARKED
    ),
    "clean_stats": _with_processed(
        f"""SELECT count(*) AS total_texts, count(*) FILTER (is_valid) AS valid_texts,
        round(avg(length(text)), 6) AS avg_length_original, round(avg(length(cleaned)), 6) AS avg_length_cleaned,
        round(avg(length(lemmatized)), 6) AS avg_length_lemmatized,
        count(*) FILTER (lang = '{ip.TARGET_LANGUAGE}') AS in_language,
        count(*) FILTER (lang <> '{ip.TARGET_LANGUAGE}') AS not_in_language FROM processed"""
    ),
    "clean_before_after": _with_processed(
        f"""SELECT count(*) AS rows_before, count(*) FILTER (is_valid) AS rows_after,
        round(avg(length(text)), 6) AS avg_length_before,
        round(avg(length(cleaned)) FILTER (is_valid), 6) AS avg_length_after,
        {sql.percent('count(*) FILTER (is_valid)', 'count(*)')} AS approval_pct FROM processed"""
    ),
    "dedup_lemmatized": _with_processed("SELECT min(id) AS id, lemmatized FROM processed WHERE is_valid GROUP BY lemmatized"),
    "dedup_counts": _with_processed(
        """SELECT count(*) AS rows_before, count(DISTINCT lemmatized) AS rows_after,
        count(*) - count(DISTINCT lemmatized) AS removed FROM processed WHERE is_valid"""
    ),
    "platform_counts": _with_processed(
        """SELECT platform, count(*) AS n FROM processed WHERE id IN
        (SELECT min(id) FROM processed WHERE is_valid GROUP BY lemmatized) GROUP BY platform"""
    ),
    "nonempty_text": sql.with_posts("SELECT id, selftext FROM posts WHERE selftext IS NOT NULL AND selftext <> ''"),
    "lemma_rules": sql.with_named("SELECT ending, cut, put, forms FROM rules", **_RULES),
    "lemma_by_rule": sql.with_named(
        f"""SELECT form, lemma FROM lexicon UNION ALL
        SELECT form, substr(form, 1, CAST(length(form) - cut AS BIGINT)) || put AS lemma FROM (
          SELECT form, cut, put, row_number() OVER (PARTITION BY form ORDER BY length(ending) DESC) AS place
          FROM (SELECT form, right(form, n) AS ending FROM (SELECT form, unnest(range(1, least({lm.LONGEST_ENDING}, length(form) - 1) + 1)) AS n FROM unseen)) JOIN rules USING (ending)
          WHERE length(form) - cut >= {lm.MIN_STEM}) WHERE place = 1""",
        **_RULES,
        unseen=f"""SELECT DISTINCT form FROM (SELECT unnest(string_split({sql.cleaned('text')}, ' ')) AS form FROM documents)
            WHERE length(form) > 1 AND form NOT IN (SELECT form FROM lexicon)""",
    ),
    "lemma_lexicon": sql.with_named(
        """SELECT m.id AS doc_id, l.lemmatized, l.lemmatized AS by_expression FROM marked m JOIN lemmas l ON l.id = m.id""",
        marked=f"SELECT doc_id AS id, {sql.cleaned('text')} AS cleaned FROM documents", lemmas=_LEMMA,
    ),
}
