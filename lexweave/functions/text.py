"""Text expressions: tokens, keys, normalising, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these words.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its",
    "shall", "may", "must", "not", "no", "any", "such", "other", "under", "over", "per", "than", "then", "there", "here", "which", "who", "whom", "whose", "what", "when", "where", "how",
)
KEY_STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "shall", "any", "such", "other", "under", "section", "act", "sub", "not", "been", "are", "was", "were", "has", "have", "had", "its", "his", "her", "they", "them", "their", "which", "who", "whom",
)
# End of the fixed values.


def tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-']*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def keys(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*KEY_STOPWORDS)))


def normalized(raw: Column) -> Column:
    """One leading enumerator stripped, white space collapsed; null where that changes nothing."""
    out = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\s*(?:\([0-9]{1,3}[A-Z]?\)|\([a-z]{1,3}\)|[0-9]{1,4}[A-Z]{0,2}\.)\s*", ""), r"\s+", " "))
    return F.when(out != raw, out)


def body(normal: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(normal, F.lit("")), raw)


def rendered(status: Column, path: Column, normal: Column, raw: Column) -> Column:
    return F.concat(F.when(status == "superseded", "[SUPERSEDED] ").otherwise(""), F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("["), path, F.lit("] "))).otherwise(""), body(normal, raw))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def assertive(kind: Column, raw: Column) -> Column:
    return (kind == "proposition") & ~raw.rlike(r"(?i)^\s*(?:illustration|example)s?\s*[-—–.:]")
