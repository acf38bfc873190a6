"""Text functions: escaping, highlights, cleaning, embedding input (OP-F8 to OP-F13, OP-F19)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, END_MARK = "<mark>", "</mark>"
EMBEDDING_CHARS = 6_000
INDEXED_CHARS = 200_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_escape(text) -> Column:
    """OP-F8. Ampersands first, so that the other escapes stay whole."""
    out = _c(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def strip_marks(text) -> Column:
    """OP-F9."""
    return F.regexp_replace(_c(text), "</?mark>", "")


def is_safe_highlight(text) -> Column:
    """OP-F9. No markup but the marks."""
    return ~strip_marks(text).rlike("[<>]")


def highlight(text, terms: list[str]) -> Column:
    """OP-F10. Escape, then mark the terms, longer ones first, whatever their case."""
    known = sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    if not known:
        return html_escape(text)
    escaped = [t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for t in known]
    return F.regexp_replace(html_escape(text), "(?iu)(" + "|".join(map(re.escape, escaped)) + ")", f"{MARK}$1{END_MARK}")


def highlight_segments(text) -> Column:
    """OP-F11. The highlighted text as an array of (text, marked), entities decoded."""
    pieces = F.split(_c(text), f"(?={MARK})|(?<={END_MARK})")
    decoded = lambda x: F.replace(F.replace(F.replace(strip_marks(x), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(decoded(p).alias("text"), p.startswith(MARK).alias("marked")))


def sanitize(text) -> Column:
    """OP-F12. Control characters go, the tab stays."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\x00-\x08\x0A-\x1F]", "")


def embedding_text(*parts) -> Column:
    """OP-F13. What is there, by blank lines, cut to the model's window."""
    given = [F.when(F.trim(_c(p)) != "", _c(p)) for p in parts]
    return F.substring(F.concat_ws("\n\n", *given), 1, EMBEDDING_CHARS)


def clean_whitespace(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def append_text(existing, added, limit: int = INDEXED_CHARS) -> Column:
    """OP-F19. ``added``, cleaned, after ``existing`` unless it is in there already; at most ``limit`` characters."""
    old, new = F.coalesce(_c(existing), F.lit("")), clean_whitespace(added)
    both = F.when(old == "", new).otherwise(F.concat_ws(" ", old, new))
    return F.substring(F.when((new == "") | F.contains(old, new), old).otherwise(both), 1, limit)
