"""Registered queries: labels, samples, folds, features, metrics and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrain.functions import text as tx
from voxgrain.operators import features as fe
from voxgrain.operators import labels as la
from voxgrain.operators import language as lg
from voxgrain.operators import metrics as me
from voxgrain.operators import profiling as pr
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql

FOLDS = 5
VALIDATION = 0.2
SAMPLE_ROWS = 600


def weak_label(spark, sf_dir):
    df = ip.documents(spark, sf_dir)
    return df.select("doc_id", la.weak_label("text", "doc_id", ip.GOOD_WORDS, ip.BAD_WORDS).alias("sentiment"))


def weak_label_default_words(spark, sf_dir):
    df = ip.documents(spark, sf_dir)
    return df.select("doc_id", la.weak_label("text", "doc_id").alias("sentiment"))


def seeded_sample(spark, sf_dir):
    return la.seeded_sample(ip.table(spark, sf_dir, "events"), "event_id", SAMPLE_ROWS).select("event_id", "event_type")


def labelled_sample(spark, sf_dir):
    df = ip.table(spark, sf_dir, "documents").withColumnRenamed("text", "lemmatized")
    found = la.labelled_sample(df, "doc_id", size=SAMPLE_ROWS, positive=ip.GOOD_WORDS, negative=ip.BAD_WORDS)
    return found.select("doc_id", "sentiment")


def _labels(spark, sf_dir):
    return ip.labelled_documents(spark, sf_dir, cleaned=False)


def _label_keys(spark, sf_dir):
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return ip.table(spark, sf_dir, "labels").select("doc_id", sentiment.alias("sentiment"))


def class_distribution(spark, sf_dir):
    return la.class_distribution(_label_keys(spark, sf_dir))


def label_codes(spark, sf_dir):
    coded = la.labelled_only(_labels(spark, sf_dir), "text")
    return coded.select("id", "sentiment", "label_code", la.label_name("label_code").alias("decoded"))


def training_guard(spark, sf_dir):
    return la.enough_rows(_labels(spark, sf_dir))


def strat_split(spark, sf_dir):
    split = la.stratified_split(_label_keys(spark, sf_dir), "sentiment", "doc_id", VALIDATION)
    return split.select("doc_id", "sentiment", "is_validation")


def strat_folds(spark, sf_dir):
    return la.stratified_folds(_label_keys(spark, sf_dir), "sentiment", "doc_id", FOLDS).select("doc_id", "sentiment", "fold")


def vocab(spark, sf_dir):
    return ip.rounded(fe.vocabulary(ip.labelled_documents(spark, sf_dir), "text"))


def tfidf_long(spark, sf_dir):
    df = ip.labelled_documents(spark, sf_dir)
    return ip.rounded(fe.tfidf_table(df, "text", "id", fe.vocabulary(df, "text")))


def _judged(spark, sf_dir):
    return _labels(spark, sf_dir).withColumn("predicted", la.weak_label("text", "id", ip.GOOD_WORDS, ip.BAD_WORDS))


def confusion_matrix(spark, sf_dir):
    return me.confusion_matrix(_judged(spark, sf_dir), "sentiment", "predicted")


def classification_report(spark, sf_dir):
    return ip.rounded(me.classification_report(_judged(spark, sf_dir), "sentiment", "predicted"))


def _detected(spark, sf_dir, df=None):
    texts = ip.documents(spark, sf_dir)
    languages = lg.language_list(texts, "lang")
    profile = lg.language_profile(texts, "text", "lang", languages, ip.PROFILE_GRAMS)
    return lg.detect_language(texts if df is None else df, "text", "doc_id", profile, languages)


def lang_profile(spark, sf_dir):
    texts = ip.documents(spark, sf_dir)
    return ip.rounded(lg.language_profile(texts, "text", "lang", ["de", "en", "es", "fr"], ip.PROFILE_GRAMS))


def lang_id(spark, sf_dir):
    return _detected(spark, sf_dir)


def language_mix(spark, sf_dir):
    sample = lg.language_sample(ip.table(spark, sf_dir, "documents"), "doc_id")
    return lg.language_mix(_detected(spark, sf_dir, sample), top=2)


def language_share(spark, sf_dir):
    return lg.language_share(_detected(spark, sf_dir), ip.TARGET_LANGUAGE)


QUERIES = {
    f.__name__: f
    for f in (
        weak_label, weak_label_default_words, seeded_sample, labelled_sample, class_distribution, label_codes,
        training_guard, strat_split, strat_folds, vocab, tfidf_long, confusion_matrix, classification_report,
        lang_profile, lang_id, language_mix, language_share,
    )
}

_KEYS = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment FROM labels"""
_NUMBERED = f"""SELECT doc_id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY {sql.draw('doc_id')}, doc_id) AS number,
    count(*) OVER (PARTITION BY sentiment) AS total FROM keys"""
_JUDGED = f"""SELECT l.sentiment, {sql.weak_label('d.text', 'd.doc_id')} AS predicted FROM keys l JOIN documents d ON d.doc_id = l.doc_id"""

_WORDS = f"""SELECT id, regexp_extract_all(text, {sql.quoted(tx.TOKEN_PATTERN)}) AS w FROM labelled"""
_TERMS = """SELECT id, unnest(w) AS term FROM words
    UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)"""
_VOCAB = f"""SELECT term, documents, occurrences, ln((n + 1.0::DOUBLE) / (documents + 1.0::DOUBLE)) + 1.0 AS idf FROM (
      SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM terms GROUP BY term),
      (SELECT count(*) AS n FROM labelled)
    WHERE documents >= {fe.MIN_DOCUMENTS} AND documents <= n * {fe.MAX_DOCUMENT_SHARE}
    ORDER BY occurrences DESC, term LIMIT {fe.MAX_FEATURES}"""


def _with_terms(query, **more):
    return sql.with_named(query, labelled=sql.LABELLED, words=_WORDS, terms=_TERMS, vocab=_VOCAB, **more)


_CLASSES = "(VALUES ('negative'), ('neutral'), ('positive')) AS {0}({0}_name)"
_REPORT = f"""
WITH keys AS ({_KEYS}), judged AS ({_JUDGED}),
c AS (SELECT c_name AS name, count(*) FILTER (sentiment = c_name AND predicted = c_name)::DOUBLE AS tp,
    count(*) FILTER (sentiment = c_name) AS support, count(*) FILTER (predicted = c_name) AS claimed
  FROM judged, {_CLASSES.format('c')} GROUP BY c_name),
r AS (SELECT name, CASE WHEN claimed = 0 THEN 0 ELSE tp / claimed END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
    CASE WHEN claimed + support = 0 THEN 0 ELSE 2 * tp / (claimed + support) END AS f1, support, tp FROM c),
a AS (SELECT name, precision, recall, f1, support FROM r
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a
"""

_LANGUAGES = ("de", "en", "es", "fr")
_CHARS = f"SELECT doc_id, lang, string_split(' ' || {sql.cleaned('text')} || ' ', '') AS ch FROM documents"
_GRAMS = """SELECT doc_id, lang, ch[i] || ch[i + 1] || ch[i + 2] AS gram
    FROM (SELECT *, unnest(range(1, len(ch) - 1)) AS i FROM chars WHERE len(ch) > 2)"""
_KEPT = (
    "SELECT gram, "
    + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{i}" for i, x in enumerate(_LANGUAGES))
    + f", count(*) AS n FROM grams GROUP BY gram ORDER BY n DESC, gram LIMIT {ip.PROFILE_GRAMS}"
)
_PROFILE = (
    "SELECT gram, "
    + ", ".join(f"ln((n_{i} + 1.0::DOUBLE) / (t_{i} + size)) AS score_{i}" for i in range(4))
    + " FROM kept, (SELECT count(*) AS size, "
    + ", ".join(f"sum(n_{i}) AS t_{i}" for i in range(4))
    + " FROM kept)"
)
_BEST = "greatest(s_0, s_1, s_2, s_3)"
_DETECTED = (
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN s_{i} = {_BEST} THEN '{x}'" for i, x in enumerate(_LANGUAGES))
    + " ELSE 'unknown' END AS detected_lang FROM (SELECT d.doc_id, "
    + ", ".join(f"round(sum(score_{i}), 6) AS s_{i}" for i in range(4))
    + " FROM documents d LEFT JOIN grams g ON g.doc_id = d.doc_id LEFT JOIN profile p ON p.gram = g.gram GROUP BY d.doc_id)"
)


def _with_profile(query):
    return sql.with_named(query, chars=_CHARS, grams=_GRAMS, kept=_KEPT, profile=_PROFILE, detected=_DETECTED)


SQL = {
    "weak_label": f"SELECT doc_id, {sql.weak_label('text', 'doc_id')} AS sentiment FROM documents",
    "weak_label_default_words": f"""SELECT doc_id,
        {sql.weak_label('text', 'doc_id', la.POSITIVE_WORDS, la.NEGATIVE_WORDS)} AS sentiment FROM documents""",
    "seeded_sample": f"SELECT event_id, event_type FROM events ORDER BY {sql.draw('event_id')}, event_id LIMIT {SAMPLE_ROWS}",
    "labelled_sample": f"""SELECT doc_id, {sql.weak_label('text', 'doc_id')} AS sentiment FROM documents
        ORDER BY {sql.draw('doc_id')}, doc_id LIMIT {SAMPLE_ROWS}""",
    "class_distribution": sql.with_named("SELECT sentiment, count(*) AS n FROM keys GROUP BY sentiment", keys=_KEYS),
    "label_codes": sql.with_named(
        """SELECT id, sentiment, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label_code,
        sentiment AS decoded FROM labelled""",
        labelled=sql.LABELLED,
    ),
    "training_guard": sql.with_named(
        f"SELECT count(*) AS n, count(*) >= {la.MIN_TRAINING_ROWS} AS enough FROM labelled", labelled=sql.LABELLED
    ),
    "strat_split": sql.with_named(
        f"SELECT doc_id, sentiment, number <= floor(total * {VALIDATION} + 0.5) AS is_validation FROM numbered",
        keys=_KEYS, numbered=_NUMBERED,
    ),
    "strat_folds": sql.with_named(
        f"SELECT doc_id, sentiment, CAST((number - 1) % {FOLDS} AS INTEGER) AS fold FROM numbered", keys=_KEYS, numbered=_NUMBERED
    ),
    "vocab": _with_terms("SELECT term, documents, occurrences, round(idf, 6) AS idf FROM vocab"),
    "tfidf_long": _with_terms(
        """SELECT w.id, w.term, round(x / sqrt(norm), 6) AS weight
        FROM w JOIN (SELECT id, sum(x * x) AS norm FROM w GROUP BY id) s ON s.id = w.id""",
        w="SELECT t.id, t.term, count(*) * any_value(v.idf) AS x FROM terms t JOIN vocab v ON v.term = t.term GROUP BY t.id, t.term",
    ),
    "confusion_matrix": sql.with_named(
        f"""SELECT a_name AS label, b_name AS prediction, count(*) FILTER (sentiment = a_name AND predicted = b_name) AS n
        FROM judged, {_CLASSES.format('a')}, {_CLASSES.format('b')} GROUP BY a_name, b_name""",
        keys=_KEYS, judged=_JUDGED,
    ),
    "classification_report": _REPORT,
    "lang_profile": _with_profile("SELECT gram, " + ", ".join(f"round(score_{i}, 6) AS score_{i}" for i in range(4)) + " FROM profile"),
    "lang_id": _with_profile("SELECT doc_id, detected_lang FROM detected"),
    "language_mix": _with_profile(
        f"""SELECT CASE WHEN place <= 2 THEN detected_lang ELSE 'outros' END AS language, CAST(sum(n) AS BIGINT) AS n,
        round(sum(n) * 100.0::DOUBLE / max(total), 4) AS pct FROM (
          SELECT detected_lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, detected_lang) AS place,
            sum(count(*)) OVER () AS total
          FROM detected WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY {sql.draw('doc_id')}, doc_id LIMIT 1000)
          GROUP BY detected_lang) GROUP BY 1"""
    ),
    "language_share": _with_profile(
        f"""SELECT {sql.percent(f"count(*) FILTER (detected_lang = '{ip.TARGET_LANGUAGE}')", 'count(*)')} AS target_pct,
        count(DISTINCT detected_lang) AS languages FROM detected"""
    ),
}
