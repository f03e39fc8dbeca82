"""Text Columns: Unicode-safe cleaning, tokens, lengths and display forms.

Everything here is a built-in expression, so a whole cleaning chain stays in one
projection and one code-generated stage next to the scan; only long word lists are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgrain.functions.word_lists import MANY_WORDS, found_words

# Character classes and patterns that decide the result.
# Java's \w and \s are ASCII only, so the Unicode classes are spelled out; the URL
# pattern is a single class because Java recurses on repeated alternations.
WORD = r"\p{L}\p{N}_"
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}"
URL_PATTERN = r"https?://[!$-_a-zA-Z]+"
MENTION_PATTERN = rf"@[{WORD}]+"
HASHTAG_PATTERN = rf"#[{WORD}]+"
NON_WORD_PATTERN = rf"[^{WORD}{SPACE}]"
SPACES_PATTERN = rf"[{SPACE}]+"
NO_WORD_PATTERN = rf"[^{WORD}]+"
TOKEN_PATTERN = rf"[{WORD}]{{2,}}"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def remove_urls(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), URL_PATTERN, "")


def remove_mentions(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), MENTION_PATTERN, "")


def remove_hashtags(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), HASHTAG_PATTERN, "")


def squeeze_spaces(text: Column | str) -> Column:
    """One plain space for each run of white space, none at either end."""
    return F.trim(F.regexp_replace(as_column(text), SPACES_PATTERN, " "))


def clean_text(text: Column | str) -> Column:
    """Lower-case; drop URLs, mentions and hashtags; keep words; squeeze spaces.

    Null gives the empty string. Texts without the first letters of what is dropped pass by those
    patterns, and one pattern both blanks out and squeezes what is no word.
    """
    lowered = F.lower(F.coalesce(as_column(text), F.lit("")))
    marked = F.contains(lowered, F.lit("#")) | F.contains(lowered, F.lit("@")) | F.contains(lowered, F.lit("http"))
    kept = F.when(marked, remove_hashtags(remove_mentions(remove_urls(lowered)))).otherwise(lowered)
    return F.trim(F.regexp_replace(kept, NO_WORD_PATTERN, " "))


def is_filled(text: Column | str) -> Column:
    """True where the text is neither null nor empty."""
    column = as_column(text)
    return column.isNotNull() & (column != "")


def length_between(text: Column | str, low: int, high: int) -> Column:
    return F.length(as_column(text)).between(low, high)


def full_text(title: Column | str, body: Column | str) -> Column:
    """Title, followed by a space and the body if there is a body."""
    title, body = as_column(title), as_column(body)
    return F.when(is_filled(body), F.concat_ws(" ", title, body)).otherwise(title)


def matched_keywords(text: Column | str, keywords: Sequence[str]) -> Column:
    """The keywords found in the text as case-insensitive substrings, in given order."""
    lowered = F.lower(as_column(text))
    if len(keywords) > MANY_WORDS:
        return found_words(lowered, [word.lower() for word in keywords], keywords)
    hits = [F.when(F.contains(lowered, F.lit(word.lower())), F.lit(word)) for word in keywords]
    return F.array_compact(F.array(*hits))


def has_keyword(text: Column | str, keywords: Sequence[str]) -> Column:
    lowered = F.lower(as_column(text))
    if len(keywords) > MANY_WORDS:
        return F.when(lowered.isNotNull(), F.size(found_words(lowered, [word.lower() for word in keywords])) > 0)
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(lowered, F.lit(word.lower()))
    return found


def occurrences(text: Column | str, word: Column | str) -> Column:
    """How often a non-empty word occurs in the text, ignoring case, without overlaps."""
    lowered = F.lower(as_column(text))
    word = F.lower(as_column(word))
    gone = F.length(lowered) - F.length(F.replace(lowered, word, F.lit("")))
    return F.floor(gone / F.length(word)).cast("long")


def tokens(text: Column | str) -> Column:
    """Lower-cased words of two characters or more, as an array in text order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def word_bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space."""
    pairs = F.arrays_zip(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("left"),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("right"),
    )
    return F.transform(pairs, lambda pair: F.concat_ws(" ", pair["left"], pair["right"]))


def words_and_bigrams(words: Column) -> Column:
    """Words and word pairs, the unit of the TF-IDF features, of a token array."""
    return F.concat(words, word_bigrams(words))


def shorten(text: Column | str, limit: int = 100) -> Column:
    """The text if it fits, else its first ``limit`` characters and an ellipsis."""
    column = as_column(text)
    return F.when(
        F.length(column) > limit, F.concat(F.substring(column, 1, limit), F.lit("..."))
    ).otherwise(column)


def slug(text: Column | str) -> Column:
    """Lower-case with spaces and hyphens as underscores, for output names."""
    return F.regexp_replace(F.lower(as_column(text)), "[ -]", "_")
