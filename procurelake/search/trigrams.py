"""Names found by a pattern without scanning them: a table of trigrams, and the pattern confirmed after (OP-P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.shared import stash


def trigram_postings(names: DataFrame, name: str = "name") -> DataFrame:
    """(trigram, name) of each distinct name, lower-cased, written in order of the trigram; names of fewer than three characters and nulls have none."""
    low = F.lower("name")
    each = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))
    rows = names.select(F.col(name).alias("name")).where(F.length(low) >= 3).distinct().select(F.explode(F.array_distinct(each)).alias("trigram"), "name")
    return stash(rows.repartitionByRange("trigram", "name").sortWithinPartitions("trigram", "name"), "trigrams")


def pieces(pattern: str) -> list[str]:
    """The literal stretches of a LIKE pattern between its wildcards, lower-cased; a backslash takes the next character as it is."""
    out, now, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            now += pattern[i]
        elif c in "%_":
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [p for p in (x.lower() for x in [*out, now]) if p]


def wanted_trigrams(pattern: str) -> list[str]:
    """Trigrams that every name of the pattern has; those with characters beyond ASCII are left to the confirmation, as lower case differs between engines there."""
    return sorted({t for p in pieces(pattern) for t in (p[i : i + 3] for i in range(len(p) - 2)) if t.isascii()})


def names_like(stored: DataFrame, names: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """The distinct names that match ``pattern`` (ILIKE): candidates have all its trigrams, the pattern decides.

    A pattern without a trigram has to read ``names``; null names match nothing.
    """
    wanted = wanted_trigrams(pattern)
    if not wanted:
        return names.select(F.col(name).alias("name")).where(F.col("name").ilike(pattern)).distinct()
    met = stored.where(F.col("trigram").isin(wanted)).groupBy("name").agg(F.count("*").alias("n"))
    return met.where((F.col("n") == len(wanted)) & F.col("name").ilike(pattern)).select("name")
