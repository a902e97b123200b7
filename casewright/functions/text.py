"""Text normalisation, tokens, shingles and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of X-redactions, with the separators inside it (a fixed pattern).
REDACTION = r"(?iU)\b[X]{2,}(?:[/\-\s][X]{2,})*\b"
MIN_TOKENS = 25


def normalize(text: Column) -> Column:
    """Redactions blanked, lower case, everything outside a-z and 0-9 one space, trimmed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    blanked = F.when(_may_redact(text), F.regexp_replace(text, REDACTION, " ")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(blanked), "[^a-z0-9]+", " "))


def _may_redact(text: Column) -> Column:
    """Whether two X stand together anywhere: without them the pattern, which is slow, cannot match."""
    return F.contains(F.lower(text), F.lit("xx"))


def redaction_ratio(text: Column) -> Column:
    """Redaction runs over white-space separated tokens; 0 without tokens."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(_may_redact(text) & (tokens > 0), F.regexp_count(text, F.lit(REDACTION)) / tokens).otherwise(F.lit(0.0))


def token_count(normalized: Column) -> Column:
    """Tokens of a normalised text, without splitting it."""
    return F.when(F.length(normalized) == 0, 0).otherwise(F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit(""))) + 1)


def text_hash(normalized: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """First 8 bytes of SHA-1 as hex; null for texts under ``min_tokens``."""
    return F.when(token_count(normalized) >= min_tokens, F.substring(F.sha1(normalized), 1, 16))


def shingles(normalized: Column, k: int = 5) -> Column:
    """Distinct word k-grams; the whole text under k words; empty for an empty text. Work grows with the text's length."""

    def grams(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))

    # The outer lambda binds the words: spelled out in the inner one, the split would run again for every shingle.
    bound = F.element_at(F.transform(F.array(F.split(normalized, " ")), grams), 1)
    return F.when(F.length(normalized) == 0, F.array().cast("array<string>")).otherwise(bound)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
