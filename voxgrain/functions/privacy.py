"""Pseudonyms and redaction of personal data, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgrain.functions.text import as_column

# What is recognised as personal data, in the order it is replaced, and
# the tag put in its place. Phones are replaced before tax ids, so an unformatted
# tax id whose third digit is 9 becomes a phone tag. Word boundaries are Unicode-aware.
REDACTIONS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (
        "phone",
        r"\b(?:\+55\s?)?(?:\(?[1-9]{2}\)?\s?)?(?:9\s?)?[0-9]{4}[-\s]?[0-9]{4}\b",
        "[TELEFONE]",
    ),
    ("cpf", r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}[-\.]?[0-9]{2}\b", "[CPF]"),
    (
        "social_profile",
        r"https?://(?:www\.)?(?:facebook|instagram|linkedin|twitter)\.com/[^\s]+",
        "[PERFIL_SOCIAL]",
    ),
)
IDENTIFIER_COLUMNS = ("username", "user_id", "email")
SHORT_HASH_CHARS = 12
SALTED_HASH_CHARS = 16
DELETED_AUTHOR = "deleted"


def salted_pseudonym(user: Column | str, platform: Column | str, salt: str) -> Column:
    """First 16 hex digits of SHA-256 over ``platform:user:salt``; null stays null."""
    if not salt:
        raise ValueError("a salt is required")
    user = as_column(user).cast("string")
    joined = F.concat_ws(":", F.coalesce(as_column(platform), F.lit("")), user, F.lit(salt))
    digest = F.substring(F.sha2(joined, 256), 1, SALTED_HASH_CHARS)
    return F.when(user.isNotNull(), digest)


def full_hash(user: Column | str) -> Column:
    """All 64 hex digits of SHA-256; null stays null."""
    return F.sha2(as_column(user).cast("string"), 256)


def author_or_deleted(author: Column | str) -> Column:
    return F.coalesce(as_column(author), F.lit(DELETED_AUTHOR))


def short_hash(user: Column | str) -> Column:
    """First 12 hex digits of SHA-256, with a missing author read as deleted."""
    return F.substring(F.sha2(author_or_deleted(user).cast("string"), 256), 1, SHORT_HASH_CHARS)


def _java(pattern: str) -> str:
    return "(?iU)" + pattern


def redact_one(text: Column | str, kind: str) -> Column:
    """Replace one kind of personal data by its tag."""
    pattern, tag = {name: (pattern, tag) for name, pattern, tag in REDACTIONS}[kind]
    return F.regexp_replace(as_column(text), _java(pattern), tag)


def redact(text: Column | str) -> Column:
    """Replace every kind of personal data, one after the other."""
    column = as_column(text)
    for kind, _, _ in REDACTIONS:
        column = redact_one(column, kind)
    return column


def hit_counts(text: Column | str) -> dict[str, Column]:
    """Per kind, how many replacements redaction makes in the text."""
    column = as_column(text)
    counts = {}
    for kind, pattern, _ in REDACTIONS:
        counts[kind] = F.regexp_count(column, F.lit(_java(pattern))).cast("long")
        column = redact_one(column, kind)
    return counts
