"""Ingest of a window of releases, end to end (SRC-4)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.operators.normalize import normalize_notices
from procurelake.operators.versions import insert_ignore, upsert
from procurelake.plans.stats import table_counts
from procurelake.shared import stash
from procurelake.sources.ocds import archive_rows, release_to_notice


class Ingested(NamedTuple):
    """The tenders after the window, its version rows, the releases to archive, and (counter, n)."""

    tenders: DataFrame
    versions: DataFrame
    archived: DataFrame
    counters: DataFrame


def ingest_window(releases: DataFrame, existing: DataFrame, archive: DataFrame, source_id: str, authority_score: int = 50) -> Ingested:
    """SRC-4. Archive a window's releases, normalise them to tenders and fold these into the ``existing`` ones.

    ``existing`` is as ``upsert`` takes it, ``archive`` has (ocid, release_id). The counters are releases,
    archived, created, updated and unchanged; a window that is run again archives and changes nothing.
    """
    fresh = stash(insert_ignore(archive, archive_rows(releases), ["ocid", "release_id"]), "archived")
    notices = release_to_notice(releases, source_id, map_value=True)
    tenders = stash(normalize_notices(notices, authority_score).withColumn("seen_at", F.col("published_at")), "normalised")
    state, versions = upsert(existing, tenders)
    versions = stash(versions, "versions")
    made = {"releases": releases, "archived": fresh, "created": versions.where("kind = 'CREATED'"), "updated": versions.where("kind != 'CREATED'")}
    counts = table_counts(made).withColumnRenamed("table", "counter")
    rest = counts.agg(F.sum(F.when(F.col("counter") == "releases", F.col("n")).when(F.col("counter") != "archived", -F.col("n"))).alias("n"))
    return Ingested(state, versions, fresh, counts.unionByName(rest.select(F.lit("unchanged").alias("counter"), "n")))
