"""Registered queries: pseudonyms, redaction and the compliance audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrain.functions import privacy as pv
from voxgrain.operators import compliance as co
from voxgrain.plans import inputs as ip
from voxgrain.plans import sql


def pseudonymize_salted(spark, sf_dir):
    return ip.posts(spark, sf_dir).select("id", pv.salted_pseudonym("username", "platform", ip.SALT).alias("user_hash"))


def hash_user_full(spark, sf_dir):
    events = ip.table(spark, sf_dir, "events")
    return events.select("event_id", pv.full_hash("user_id").alias("user_hash"))


def hash_user_short(spark, sf_dir):
    """Authors of error events count as deleted here, to show the stand-in."""
    events = ip.table(spark, sf_dir, "events")
    author = F.when(F.col("event_type") != "error", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return events.select("event_id", pv.author_or_deleted(author).alias("username"), pv.short_hash(author).alias("user_hash"))


def redact_pii(spark, sf_dir):
    return ip.documents(spark, sf_dir).select("doc_id", pv.redact("text").alias("text_clean"))


def redact_kinds(spark, sf_dir):
    """Each kind on its own, over texts that hold made-up contacts of every kind."""
    numbered = F.lpad(F.col("page_id").cast("string"), 4, "0")
    line = F.concat(
        F.lit("a"), numbered, F.lit("@mail.example.com; (11) 9"), numbered, F.lit("-1234; 123.456.789-09; "),
        F.lit("https://www.instagram.com/u"), numbered, F.lit(" fim; "), F.col("url"),
    )
    kinds = [kind for kind, _, _ in pv.REDACTIONS]
    df = ip.table(spark, sf_dir, "pages").select("page_id", line.alias("line"))
    return df.select("page_id", *[pv.redact_one("line", k).alias(f"no_{k}") for k in kinds], pv.redact("line").alias("text_clean"))


def pii_hits(spark, sf_dir):
    counts = pv.hit_counts("text")
    per_text = ip.documents(spark, sf_dir).select(*[c.alias(k) for k, c in counts.items()])
    return per_text.agg(
        *[F.sum(k).alias(f"{k}_hits") for k in counts],
        *[F.count(F.when(F.col(k) > 0, 1)).alias(f"{k}_texts") for k in counts],
    )


def drop_identifiers(spark, sf_dir):
    df = ip.posts(spark, sf_dir).select("id", "username", "platform", "score")
    return co.drop_identifiers(df)


def anonymized_posts(spark, sf_dir):
    df = ip.text_posts(spark, sf_dir).select("id", "text", "username", "platform")
    return co.anonymize_posts(df, "reddit", ip.SALT, keep_raw_text=False)


# The queries' own wording of the audit.
PRIVACY_TERMS = {
    "anonymization_method": "salted hash", "pii_removal": "yes", "retention_policy": "30 days", "legal_basis": "consent",
    "data_controller": "Sample Lab", "contact_dpo": "privacy@sample.example",
}
USER_RIGHTS = {"access": "on request", "erasure": "at the end of retention"}
PLATFORM_TERMS = {"platform": "Reddit", "allowed_use": "internal tests", "commercial_use": "no"}


def _audit(spark, sf_dir):
    df = ip.posts(spark, sf_dir).select("id", "text", "username")
    return co.compliance_audit(df, "reddit", ip.AS_OF, PRIVACY_TERMS, USER_RIGHTS, PLATFORM_TERMS)


def compliance_audit(spark, sf_dir):
    return _audit(spark, sf_dir).select(
        "lgpd.collected_at", "lgpd.data_source", "lgpd.retention_policy", F.col("tos.platform").alias("tos_platform"),
        "processing_info.original_records", "processing_info.final_records",
        F.array_join("processing_info.columns_removed", ",").alias("columns_removed"),
    )


def compliance_report_rows(spark, sf_dir):
    return co.compliance_rows(_audit(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        pseudonymize_salted, hash_user_full, hash_user_short, redact_pii, redact_kinds, pii_hits,
        drop_identifiers, anonymized_posts, compliance_audit, compliance_report_rows,
    )
}

_PATTERNS = {kind: ("(?i)" + pattern, tag) for kind, pattern, tag in pv.REDACTIONS}


def _redact(expression):
    for pattern, tag in _PATTERNS.values():
        expression = sql.replaced(expression, pattern, tag)
    return expression


def _hits(expression):
    found = {}
    for kind, (pattern, tag) in _PATTERNS.items():
        found[kind] = f"len(regexp_extract_all({expression}, {sql.quoted(pattern)}))"
        expression = sql.replaced(expression, pattern, tag)
    return found


_LINE = (
    "'a' || lpad(page_id::VARCHAR, 4, '0') || '@mail.example.com; (11) 9' || lpad(page_id::VARCHAR, 4, '0') || "
    "'-1234; 123.456.789-09; https://www.instagram.com/u' || lpad(page_id::VARCHAR, 4, '0') || ' fim; ' || url"
)
_AUTHOR = "CASE WHEN event_type <> 'error' THEN 'u' || user_id ELSE 'deleted' END"
_ROWS = (
    [("lgpd", "collected_at", ip.AS_OF), ("lgpd", "data_source", "reddit")]
    + [("lgpd", "anonymization_method", "salted hash"), ("lgpd", "pii_removal", "yes"), ("lgpd", "retention_policy", "30 days"),
       ("lgpd", "legal_basis", "consent"), ("lgpd", "data_controller", "Sample Lab"), ("lgpd", "contact_dpo", "privacy@sample.example")]
    + [("user_rights", "access", "on request"), ("user_rights", "erasure", "at the end of retention")]
    + [("tos", "platform", "Reddit"), ("tos", "allowed_use", "internal tests"), ("tos", "commercial_use", "no")]
    + [("tos", "compliance_date", ip.AS_OF)]
    + [("processing_info", k, v) for k, v in (
        ("anonymization_applied", "true"), ("pii_removal_applied", "true"), ("columns_removed", "username"))]
)

SQL = {
    "pseudonymize_salted": sql.with_posts(
        f"SELECT id, substr(sha256(platform || ':' || username || ':{ip.SALT}'), 1, 16) AS user_hash FROM posts"
    ),
    "hash_user_full": "SELECT event_id, sha256(user_id::VARCHAR) AS user_hash FROM events",
    "hash_user_short": f"""SELECT event_id, {_AUTHOR} AS username, substr(sha256({_AUTHOR}), 1, 12) AS user_hash FROM events""",
    "redact_pii": f"SELECT doc_id, {_redact('text')} AS text_clean FROM documents",
    "redact_kinds": f"""SELECT page_id, {', '.join(f"{sql.replaced(_LINE, p, t)} AS no_{k}" for k, (p, t) in _PATTERNS.items())},
        {_redact(_LINE)} AS text_clean FROM pages""",
    "pii_hits": "SELECT "
    + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {k}_hits, count(*) FILTER ({e} > 0) AS {k}_texts" for k, e in _hits("text").items())
    + " FROM documents",
    "drop_identifiers": sql.with_posts("SELECT id, platform, score FROM posts"),
    "anonymized_posts": sql.with_posts(
        f"""SELECT id, platform, substr(sha256('reddit:' || username || ':{ip.SALT}'), 1, 16) AS user_hash,
        {_redact('text')} AS text_clean FROM posts"""
    ),
    "compliance_audit": sql.with_posts(
        f"""SELECT '{ip.AS_OF}' AS collected_at, 'reddit' AS data_source,
        '30 days' AS retention_policy, 'Reddit' AS tos_platform,
        count(*) AS original_records, count(*) AS final_records, 'username' AS columns_removed FROM posts"""
    ),
    "compliance_report_rows": sql.with_posts(
        "SELECT * FROM (VALUES "
        + ", ".join(f"({sql.quoted(a)}, {sql.quoted(b)}, {sql.quoted(c)})" for a, b, c in _ROWS)
        + """) AS v(section, key, value)
        UNION ALL SELECT 'processing_info', 'original_records', count(*)::VARCHAR FROM posts
        UNION ALL SELECT 'processing_info', 'final_records', count(*)::VARCHAR FROM posts"""
    ),
}
