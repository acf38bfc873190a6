"""Counts for the front page and ingest reports (OP-A1, OP-A12, OP-A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_STATUSES = ("OPEN", "CLOSING_SOON", "EXTENDED", "RE_ADVERTISED", "NEW")


def stats(tenders: DataFrame) -> DataFrame:
    """OP-A1. (facet, value, n) by status and by province, in one pass over the tenders."""
    faceted = tenders.select(
        F.explode(F.array(F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")), F.struct(F.lit("province").alias("facet"), F.coalesce("province", F.lit("Unspecified")).alias("value")))).alias("f")
    )
    return faceted.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def open_count(tenders: DataFrame) -> DataFrame:
    return tenders.agg(F.count_if(F.col("status").isin(*OPEN_STATUSES)).alias("open"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """OP-A12. (table, n)."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """OP-A14."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
