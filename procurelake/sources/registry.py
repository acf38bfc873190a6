"""The source registry, hashed bulletins, stored objects and page evidence (SRC-12 to SRC-18)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions.keys import content_hash, object_key
from procurelake.schemas import registry
from procurelake.shared import stash

#: Polling interval by tier where the registry names none, in minutes.
TIER_FREQUENCY = {1: 30, 2: 90, 3: 300, 4: 1440}
PAGE_CHARS = 500_000
OCR_CHARS_PER_PAGE = 25

#: SRC-17. Scan builders by adapter name.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def adapter(key: str):
    """Register a scan builder; a name is taken once."""

    def put(build):
        if key in ADAPTERS:
            raise ValueError(f"adapter {key!r} is registered already")
        ADAPTERS[key] = build
        return build

    return put


def run_adapters(spark: SparkSession, sources: list[tuple[str, str, dict]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """SRC-17. (notices of all sources, errors): ``sources`` are (source_id, adapter, options); a source that fails is named with its error and the others' notices stay.

    Each scan is built and its rows written before the next, so what a source reads cannot fail the others later.
    """
    notices, errors = None, []
    for source_id, name, options in sources:
        try:
            if name not in ADAPTERS:
                raise KeyError(f"no adapter {name!r}; there are {sorted(ADAPTERS)}")
            rows = stash(ADAPTERS[name](spark, source_id, **options), "notices")
        except Exception as e:  # whatever a source does wrong is its own error
            errors.append((source_id, f"{type(e).__name__}: {e}"))
            continue
        notices = rows if notices is None else notices.unionByName(rows)
    return notices, errors


def seed_registry(registered: DataFrame, organisations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-15. (new organisations, new sources) of the registry's rows; what is there by name already stays as it is.

    ``organisations(name)`` and ``sources(name)`` are those stored; a name that the registry repeats counts once.
    """
    fresh = registered.where("name is not null").dropDuplicates(["name"])
    orgs = fresh.select("name", "type", "province", "website").join(organisations.select("name"), "name", "left_anti")
    rows = fresh.select(
        "name", F.col("tender_url").alias("crawl_url"), F.coalesce("platform", F.lit("UNKNOWN")).alias("platform"), F.coalesce("crawl_method", F.lit("NONE")).alias("crawl_method"), "adapter", "triage_tier",
        F.coalesce("authority_score", F.lit(50)).alias("authority_score"), "frequency_min", F.coalesce("status", F.lit("DISCOVERY")).alias("status"), F.nullif("note", F.lit("")).alias("note"),
    )
    return orgs, rows.join(sources.select("name"), "name", "left_anti")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14. Registered sources; a missing interval comes from the tier."""
    rows = spark.read.schema(registry()).option("multiLine", True).json(path)
    default = F.create_map(*[F.lit(x) for kv in TIER_FREQUENCY.items() for x in kv])
    return rows.withColumn("frequency_min", F.coalesce("frequency_min", F.element_at(default, F.col("triage_tier"))))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15, SNK-13. Files with digest and fan-out key; equal contents once, under the smallest path."""
    files = spark.read.format("binaryFile").load(path).withColumn("digest", content_hash(F.col("content")))
    once = files.groupBy("digest").agg(F.min("path").alias("path"))
    return files.join(once, ["digest", "path"], "left_semi").withColumn("object_key", object_key(F.col("digest")))


def changed_bulletins(bulletins: DataFrame, known: DataFrame) -> DataFrame:
    """SRC-12. ``bulletins(source_id, url, content)`` whose digest differs from the last in ``known(source_id, url, digest, seen_at)``."""
    hashed = bulletins.withColumn("digest", content_hash(F.col("content")))
    last = known.groupBy("source_id", "url").agg(F.max_by("digest", "seen_at").alias("digest"))
    return hashed.join(last, ["source_id", "url", "digest"], "left_anti")


def text_verdict(documents: DataFrame) -> DataFrame:
    """SRC-16. ``documents(text, pages)`` with needs_ocr: too little text for the number of pages."""
    return documents.withColumn("needs_ocr", F.length(F.trim(F.coalesce("text", F.lit("")))) < OCR_CHARS_PER_PAGE * F.greatest("pages", F.lit(1)))


def document_verdict(files: DataFrame) -> DataFrame:
    """SRC-16. ``files(filename, head, text, pages)`` with kind, needs_ocr and warnings; ``head`` is the beginning of the file, ``text`` what was got out of it.

    A file is a PDF by its first bytes or its name; one of another kind has no text and is reported, as is one
    with too little text for its pages. A null name is an unknown one; null text or pages count as none.
    """
    name = F.coalesce("filename", F.lit(""))
    pdf = (F.substring(F.coalesce("head", F.lit("")), 1, 5) == "%PDF-") | F.endswith(F.lower(name), F.lit(".pdf"))
    text = F.when(pdf, F.coalesce("text", F.lit(""))).otherwise("")
    pages, length = F.coalesce("pages", F.lit(0)), F.length(F.btrim(text, F.lit(" \t\n\r\f\v")))
    ocr = pdf & (pages > 0) & (length < OCR_CHARS_PER_PAGE * pages)
    unknown = F.concat(F.lit("unsupported document type: "), F.when(name != "", name).otherwise("unknown"))
    scanned = F.format_string("scanned document (%d characters on %d pages), needs OCR", length, pages)
    warnings = F.array_compact(F.array(F.when(~pdf, unknown), F.when(ocr, scanned)))
    return files.withColumns({"text": text, "kind": F.when(pdf, "pdf").otherwise("unknown"), "needs_ocr": ocr, "warnings": warnings})


def page_evidence(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC-13. The pages with pdf_links, total_links and scripts counted in their first half million characters."""
    body = F.substring(F.coalesce(F.col(html), F.lit("")), 1, PAGE_CHARS)
    counts = {"pdf_links": r"(?i)href=[\"'][^\"']+\.pdf", "total_links": r"(?i)<a\s", "scripts": r"(?i)<script\b"}
    return pages.withColumns({name: F.regexp_count(body, F.lit(pattern)) for name, pattern in counts.items()})


def tenders_with_buyer(tenders: DataFrame, organisations: DataFrame) -> DataFrame:
    """SRC-18. Every tender with its buyer's name, null where it has none."""
    names = organisations.select(F.col("id").alias("buyer_org_id"), F.col("name").alias("buyer_org_name"))
    return tenders.join(names, "buyer_org_id", "left")
