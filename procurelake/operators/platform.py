"""Platform of a source from the evidence of its pages (OP-D10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of protection services.
WALLS = ("cloudflare", "incapsula", "sucuri", "akamai")


def classify_platform(pages: DataFrame) -> DataFrame:
    """``pages(url, status_code, headers, html, feed_url, sitemap_ok, pdf_links, total_links, scripts, error)`` with the verdict
    (platform, adapter, crawl_method, confidence, note); the first rule that fits decides, and null counts as absent."""
    low = F.lower(F.coalesce("html", F.lit("")))
    headers = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    header = lambda name: F.lower(F.coalesce(F.element_at(headers, name), F.lit("")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    walls = "|".join(WALLS)
    walled = header("server").rlike(walls) | F.array_contains(F.map_keys(headers), "cf-ray") | F.substring(low, 1, 3000).rlike(walls)
    status = F.col("status_code")

    def verdict(platform: str, adapter: str | None, method: str, confidence: float, note) -> Column:
        note = F.lit(note) if isinstance(note, str) else note
        return F.struct(F.lit(platform).alias("platform"), F.lit(adapter).cast("string").alias("adapter"), F.lit(method).alias("crawl_method"), F.lit(confidence).alias("confidence"), note.alias("note"))

    rules = [
        (status.isNull(), verdict("UNKNOWN", None, "NONE", 0.9, F.concat(F.lit("unreachable: "), F.coalesce("error", F.lit("connection failed"))))),
        (status.isin(403, 429, 503) & walled, verdict("UNKNOWN", None, "PLAYWRIGHT", 0.85, F.format_string("blocked by a protection service (HTTP %d)", status))),
        (status >= 400, verdict("NONE", None, "NONE", 0.7, F.format_string("HTTP %d", status))),
        (low.rlike("wp-content|wp-json") | F.contains(header("x-powered-by"), F.lit("wordpress")), verdict("WORDPRESS", "generic_cms", "HTML", 0.9, "wordpress marks")),
        (header("x-generator").startswith("drupal") | low.rlike(r"drupal\.settings|/sites/default/files"), verdict("DRUPAL", "generic_cms", "HTML", 0.9, "drupal marks")),
        (F.contains(F.substring(low, 1, 5000), F.lit("joomla")) | F.contains(low, F.lit("/media/jui/")), verdict("JOOMLA", "generic_cms", "HTML", 0.85, "joomla marks")),
        (F.coalesce("feed_url", F.lit("")) != "", verdict("RSS", "generic_sitemap_rss", "HTML", 0.85, F.concat(F.lit("feed: "), F.col("feed_url")))),
        ((n("pdf_links") >= 3) & (n("pdf_links") * 2 >= n("total_links")) & (n("total_links") > 0), verdict("PDF_ONLY", "pdf_bulletin", "PDF", 0.75, "most links are PDFs")),
        (F.coalesce("sitemap_ok", F.lit(False)), verdict("SITEMAP_ONLY", "generic_sitemap_rss", "HTML", 0.7, "sitemap only")),
        ((F.length(low) < 3000) & (n("total_links") < 5) & (n("scripts") >= 2), verdict("CUSTOM_HTML", None, "PLAYWRIGHT", 0.6, "script shell")),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return pages.withColumn("verdict", out.otherwise(verdict("CUSTOM_HTML", None, "HTML", 0.5, "no generic marks"))).select(*pages.columns, "verdict.*")
