"""Identity keys of notices and organisations (OP-F1 to OP-F7), as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that say nothing about which organisation is meant, longest first.
ORG_NOISE = (
    "metropolitan municipality",
    "metro municipality",
    "local municipality",
    "district municipality",
    "municipality",
    "city of",
    "province of",
    "provincial government",
    "government of",
    "the",
)
#: Separators in tender numbers.
NUMBER_SEPARATORS = r"[\s/\-.:()_,;#|\\]+"
TITLE_KEY_LENGTH = 120
SIMILAR_TITLES = 0.6


def _text(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def tender_number_key(number) -> Column:
    """OP-F1. Lower case, leading zeros of every digit run gone, separators gone; null gives the empty key."""
    low = F.lower(F.trim(_text(number)))
    return F.regexp_replace(F.regexp_replace(low, r"(?<![0-9])0+(?=[0-9])", ""), NUMBER_SEPARATORS, "")


def org_key(name) -> Column:
    """OP-F2. Lower case, noise phrases gone where they are whole words, then only a-z and 0-9."""
    phrases = r"\b(?:" + "|".join(ORG_NOISE) + r")\b"
    return F.regexp_replace(F.regexp_replace(F.lower(_text(name)), phrases, " "), r"[^a-z0-9]+", "")


def title_key(title) -> Column:
    return F.substring(F.regexp_replace(F.lower(_text(title)), r"[^a-z0-9]+", ""), 1, TITLE_KEY_LENGTH)


def fingerprint(buyer_key, number_key, title, closing_date) -> Column:
    """OP-F3. SHA-256 over buyer, number, title and closing date; what is missing stays as an empty part."""
    date = F.date_format(closing_date, "yyyy-MM-dd")
    return F.sha2(F.concat_ws("|", _text(buyer_key), _text(number_key), title_key(title), F.coalesce(date, F.lit(""))), 256)


def natural_key(buyer_key, number_key) -> Column:
    """OP-F4. buyer|number, or null when either is missing: a title alone identifies nothing."""
    buyer, number = _text(buyer_key), _text(number_key)
    return F.when((buyer != "") & (number != ""), F.concat_ws("|", buyer, number))


def word_set(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit("([a-z0-9]+)"), F.lit(1)))


def title_similarity(a, b) -> Column:
    """OP-F5. Jaccard similarity of the sets of a-z0-9 words; 0 when either set is empty."""
    both = F.size(F.array_intersect(word_set(a), word_set(b)))
    all_ = F.size(F.array_union(word_set(a), word_set(b)))
    return F.when((F.size(word_set(a)) == 0) | (F.size(word_set(b)) == 0), F.lit(0.0)).otherwise(both / all_)


def titles_similar(a, b, threshold: float = SIMILAR_TITLES) -> Column:
    return title_similarity(a, b) >= threshold


def content_hash(content) -> Column:
    """OP-F6."""
    return F.sha2(content, 256)


def object_key(digest) -> Column:
    """OP-F7. docs/ab/cd/<digest>."""
    return F.concat_ws("/", F.lit("docs"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)
