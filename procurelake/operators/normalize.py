"""Notices to canonical tenders, status, shaping (OP-D1, OP-D2, OP-P2, OP-P3, OP-P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.keys import fingerprint, natural_key, org_key, tender_number_key
from procurelake.functions.times import closing_with_default_hour, looks_date_only, to_sast
from procurelake.schemas import PROVENANCE

#: Confidences and thresholds.
STRUCTURED, UNSTRUCTURED, INFERRED = 0.98, 0.70, 0.75
VERIFIED = 0.80
HIGH_STAKES = ("closing_at", "value_estimated", "requirements")
CLOSING_SOON_HOURS = 72
CLOSING_NOTE = "closing date published without a time; SCM 11:00 SAST convention"


def provenance(source, source_id, confidence, note) -> Column:
    return F.struct(source.alias("source"), source_id.alias("source_id"), F.lit(confidence).cast("double").alias("confidence"), note.alias("note")).cast(PROVENANCE)


def normalize_notices(notices: DataFrame, authority_score=50, structured: bool = True) -> DataFrame:
    """OP-D1. Canonical tenders with provenance of every field that is there, and the high-stakes fields that need review.

    A repaired field is DERIVED at full confidence with the repair's note; a closing date without a time gets
    eleven o'clock and is INFERRED. ``authority_score`` is a number or a column.
    """
    confidence = STRUCTURED if structured else UNSTRUCTURED
    no_time = F.coalesce(looks_date_only("closing_at"), F.lit(False))
    source_id = F.col("source_id")

    def of(name: str, there: Column, inferred: Column | None = None) -> Column:
        note = F.element_at("derived_fields", name)
        plain = provenance(F.when(note.isNotNull(), "DERIVED").otherwise("SOURCE"), source_id, confidence, note)
        if inferred is not None:
            plain = F.when(inferred, provenance(F.lit("INFERRED"), source_id, INFERRED, F.lit(CLOSING_NOTE))).otherwise(plain)
        return F.struct(F.lit(name).alias("key"), F.when(there, plain).alias("value"))

    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    entries = F.array(
        of("title", text("title")), of("tender_number", text("tender_number")), of("buyer_name", text("buyer_name")),
        of("published_at", F.col("published_at").isNotNull()), of("compulsory_briefing", F.col("compulsory_briefing").isNotNull()),
        of("briefing_at", F.col("briefing_at").isNotNull()), of("closing_at", F.col("closing_at").isNotNull(), no_time),
    )
    rows = notices.withColumns(
        {
            "field_provenance": F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())),
            "title": F.trim("title"),
            "authority_score": authority_score if isinstance(authority_score, Column) else F.lit(authority_score),
            "normalized_tender_number": tender_number_key("tender_number"),
            "buyer_key": org_key("buyer_name"),
            "closing_at": closing_with_default_hour("closing_at"),
            "source_urls": F.array("source_url"),
        }
    )
    local_day = to_sast("closing_at").cast("date")
    return rows.withColumns(
        {
            "fingerprint": fingerprint("buyer_key", "normalized_tender_number", "title", local_day),
            "natural_key": natural_key("buyer_key", "normalized_tender_number"),
            "review_items": review_items("field_provenance"),
        }
    )


def review_items(provenance_map) -> Column:
    """OP-P15. (field, confidence) of the high-stakes fields below the threshold."""
    entries = F.map_entries(provenance_map)
    low = F.filter(entries, lambda e: e["key"].isin(*HIGH_STAKES) & (e["value"]["confidence"] < VERIFIED))
    return F.transform(low, lambda e: F.struct(e["key"].alias("field"), e["value"]["confidence"].alias("confidence")))


def tender_status(closing_at, confidence, as_of, cancelled=None, awarded=None) -> Column:
    """OP-D2. CANCELLED, AWARDED, UNKNOWN (no verified date), CLOSED, CLOSING_SOON or OPEN at ``as_of``."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    flag = lambda x: F.lit(False) if x is None else F.coalesce(c(x), F.lit(False))
    closing = c(closing_at)
    return (
        F.when(flag(cancelled), "CANCELLED")
        .when(flag(awarded), "AWARDED")
        .when(closing.isNull() | (F.coalesce(c(confidence), F.lit(0.0)) < VERIFIED), "UNKNOWN")
        .when(closing <= as_of, "CLOSED")
        .when(closing <= as_of + F.expr(f"INTERVAL {CLOSING_SOON_HOURS} HOURS"), "CLOSING_SOON")
        .otherwise("OPEN")
    )


def shape_tenders(tenders: DataFrame) -> DataFrame:
    """OP-P2, OP-P3. Result rows: buyer and closing as structs, a note only for derived dates, a link to verify unverified ones."""
    closing = F.element_at("field_provenance", "closing_at")
    verified = F.coalesce(closing["confidence"], F.lit(0.0)) >= VERIFIED
    marks = [c for c in ("title_highlight", "snippet") if c in tenders.columns]
    nothing = F.lit(True)
    for c in marks:
        nothing = nothing & F.col(c).isNull()
    shaped = tenders.select(
        "id", "title", "tender_number", "province", "status", "published_at",
        F.struct(F.col("buyer_org_id").alias("id"), F.col("buyer_name").alias("name")).alias("buyer"),
        F.struct(
            F.col("closing_at").alias("at"), verified.alias("verified"), closing["confidence"].alias("confidence"),
            F.when(closing["source"].isin("DERIVED", "INFERRED"), closing["note"]).alias("note"),
            F.when(~verified, F.element_at("source_urls", 1)).alias("verify_at_source"),
        ).alias("closing"),
        F.col("value_estimated").cast("double").alias("value_estimated"),
        *([F.when(~nothing, F.struct(*marks)).alias("highlight")] if marks else []),
    )
    return shaped


def quarantine(tenders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-P22. (fit rows, rows that close before they were published)."""
    wrong = F.coalesce(F.col("closing_at") < F.col("published_at"), F.lit(False))
    return tenders.where(~wrong), tenders.where(wrong)
