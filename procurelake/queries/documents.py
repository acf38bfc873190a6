"""Queries on document texts, pages, extraction and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions import keys as K
from procurelake.functions import text as X
from procurelake.operators import extract as E
from procurelake.operators.platform import classify_platform
from procurelake.queries.tables import instant, table, tenders
from procurelake.search.match import with_index  # noqa: F401
from procurelake.sources import registry as R


def exact_dup_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", K.content_hash(F.col("text")).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def object_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", K.content_hash(F.col("text")).alias("digest"))
    return d.select("doc_id", K.object_key(F.col("digest")).alias("object_key"))


def changed_bulletins(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).cast("string").alias("source_id"), "url", F.col("html").cast("binary").alias("content"), "page_id")
    known = p.where("page_id % 2 = 0").select("source_id", "url", K.content_hash(F.col("content")).alias("digest"), F.col("page_id").alias("seen_at"))
    return R.changed_bulletins(p, known).select("page_id", "digest")


def page_link_counts(spark, sf_dir):
    return R.page_evidence(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "pdf_links", "total_links", "scripts")


def platform_classify(spark, sf_dir):
    p = R.page_evidence(table(spark, sf_dir, "pages"))
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 200, 403, 500)]), (F.col("page_id") % 5 + 1).cast("int"))
    headers = F.when(F.col("page_id") % 10 == 3, F.create_map(F.lit("Server"), F.lit("cloudflare")))
    e = p.withColumns(
        {
            "status_code": F.when(F.col("page_id") % 11 != 0, status), "headers": headers, "error": F.lit(None).cast("string"), "sitemap_ok": F.col("page_id") % 7 == 0,
            "feed_url": F.when(F.col("page_id") % 6 == 0, F.col("url")), "pdf_links": F.when(F.col("page_id") % 4 == 0, F.col("total_links")).otherwise(F.col("pdf_links")),
        }
    )
    return classify_platform(e).select("page_id", "platform", "adapter", "crawl_method", "confidence")


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.html_escape("html"), 256).alias("digest"))


def highlight_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", X.highlight("text", ["the", "ing"]).alias("marked"))
    return b.select("item_id", "marked", X.is_safe_highlight("marked").alias("safe"))


def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.sanitize("text"), 256).alias("digest"))


def embedding_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(X.embedding_text("source", "lang", "text"), 256).alias("digest"))


def append_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # what is added lies in the text already, or is new
    both = X.append_text("text", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 251, 100)).otherwise(F.col("source")))
    return d.select("doc_id", F.length(both).alias("length"), F.sha2(both, 256).alias("digest"))


def document_verdicts(spark, sf_dir):
    """Documents as files, of which some are no PDF and some scans."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 7 != 0, F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".docx").otherwise(""))).alias("filename"),
        F.when(k % 4 == 0, "%PDF-1.7").otherwise("PK").alias("head"), "text", (k % 60).cast("int").alias("pages"),
    )
    return R.document_verdict(d).select("doc_id", "kind", "needs_ocr", F.array_join("warnings", "; ").alias("warnings"))


def needs_ocr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40 + 1).cast("int").alias("pages"))
    return R.text_verdict(d).select("doc_id", "needs_ocr")


def _notices(spark, sf_dir):
    """Orders written out as notices, as text to extract from; dealt out first, since a table of one small file is one task."""
    t = tenders(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id")
    value = F.format_number("value_estimated", 2)
    body = F.concat(
        F.lit("INVITATION\nTender No: "), "tender_number", F.lit(".\nClosing date: "), F.coalesce(F.date_format("closing_at", "yyyy-MM-dd"), F.lit("to be advised")), F.when(F.col("id") % 2 == 0, F.lit(" at 10:30")).otherwise(""),
        F.when(F.col("id") % 3 == 0, F.lit("\nA compulsory briefing session will be held on 12/03/1998 at 9h15.")).otherwise(F.lit("\nA non-compulsory site meeting on 4 May 1998.")),
        F.when(F.col("id") % 5 == 0, F.lit("\nCIDB grading 7GB and 6 CE or higher")).otherwise(""), F.lit("\nB-BBEE level "), (F.col("id") % 8 + 1).cast("string"), F.lit(". Contact Buyer"), F.col("buyer_org_id").cast("string"),
        F.lit("@example.org or 031 555-0"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(".\nEstimated value: R "), value,
    )
    return t.select(F.col("id").alias("doc_id"), body.alias("text"))


def extract_notices(spark, sf_dir):
    x = E.extract_fields(_notices(spark, sf_dir))
    day = lambda c: F.date_format(F.col(c)["value"], "yyyy-MM-dd HH:mm")
    return x.select(
        "doc_id", F.col("tender_number.value").alias("tender_number"), day("closing_at").alias("closing_utc"), F.col("closing_at.confidence").alias("closing_confidence"), day("briefing_at").alias("briefing_utc"),
        F.col("compulsory_briefing.value").alias("compulsory"), F.array_join("cidb_grades.value", ",").alias("grades"), F.col("bbee_level.value").alias("level"), F.col("contact_email.value").alias("email"),
        F.col("contact_phone.value").alias("phone"), F.col("value_estimated.value").alias("value"),
    )


def extract_documents(spark, sf_dir):
    """The extractor over all documents (prose in which few fields occur); its look-arounds have no SQL here."""
    return E.long_form(E.extract_fields(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _found(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    field = F.element_at(F.array(*[F.lit(f) for f in ("closing_at", "briefing_at", "value_estimated", "contact_email")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("tender_id"), field.alias("field"), F.col("event_type").alias("value"), (F.col("event_id") / F.lit(1e6) + (F.col("event_id") % 7) / F.lit(10.0) + 0.3).alias("confidence"))


def enrich_gate(spark, sf_dir):
    f = _found(spark, sf_dir)
    now = f.groupBy("tender_id", "field").agg(F.min("value").alias("value"), (F.avg("confidence") + 0.25).alias("confidence"))
    return E.enrich(f, now.where("tender_id % 3 != 0")).select("tender_id", "field", "value", F.round("confidence", 9).alias("confidence"), "apply", "review")


def _queue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("tender_id"), F.when(F.col("event_type") == "error", "closing_at").otherwise(F.col("event_type")).alias("field"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("value"),
        F.col("ts").alias("queued_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("resolved_at"), F.lit(None).cast("string").alias("resolution"),
    )


def review_depth(spark, sf_dir):
    return E.review_depth(_queue(spark, sf_dir))


def review_page(spark, sf_dir):
    return _queue(spark, sf_dir).where("resolved_at is null").orderBy(*E.review_order()).limit(30).select("id", "field", "queued_at")


def review_enqueue(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("tender_id"), F.when(F.col("o_orderkey") % 2 == 0, "closing_at").otherwise("click").alias("field"))
    return E.enqueue_reviews(_queue(spark, sf_dir), items)


def review_resolve(spark, sf_dir):
    q = _queue(spark, sf_dir)
    decisions = q.select("id", F.element_at(F.array(F.lit("approve"), F.lit("correct"), F.lit("reject")), (F.col("id") % 3 + 1).cast("int")).alias("action"), F.lit("given").alias("value"), instant("2024-02-01 00:00:00").alias("decided_at")).where("id % 4 = 0")
    writes, after = E.resolve_reviews(q, decisions)
    done = after.where("resolution is not null").groupBy(F.lit("resolved ").alias("k"), F.col("resolution").alias("v")).agg(F.count("*").alias("n"))
    return writes.groupBy(F.lit("written ").alias("k"), F.coalesce(F.when(F.col("value") == "given", "given"), F.lit("kept")).alias("v")).agg(F.count("*").alias("n")).unionByName(done).select(F.concat("k", "v").alias("what"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        exact_dup_docs, object_key, changed_bulletins, page_link_counts, platform_classify, html_escape, highlight_terms, sanitize_text, embedding_text, append_text, needs_ocr, document_verdicts,
        extract_notices, extract_documents, enrich_gate, review_depth, review_page, review_enqueue, review_resolve,
    )
}

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_COUNTS = r"""len(regexp_extract_all(html, '(?i)href=["''][^"'']+\.pdf')) AS pdf_links, len(regexp_extract_all(html, '(?i)<a\s')) AS total_links, len(regexp_extract_all(html, '(?i)<script\b')) AS scripts"""
_QUEUE = """queue AS (SELECT event_id AS id, user_id AS tender_id, CASE WHEN event_type = 'error' THEN 'closing_at' ELSE event_type END AS field, CASE WHEN event_id % 5 <> 0 THEN props END AS value,
  ts AS queued_at, CASE WHEN event_id % 3 = 0 THEN ts END AS resolved_at FROM events)"""

ORACLE_SQL = {
    "exact_dup_docs": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "object_key": "SELECT doc_id, 'docs/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) AS object_key FROM documents",
    "changed_bulletins": """WITH p AS (SELECT page_id, page_id % 50 AS source_id, url, sha256(html) AS digest FROM pages), last AS (SELECT source_id, url, arg_max(digest, page_id) AS digest FROM p WHERE page_id % 2 = 0 GROUP BY 1, 2)
      SELECT page_id, digest FROM p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.source_id = p.source_id AND l.url = p.url AND l.digest = p.digest)""",
    "page_link_counts": f"SELECT page_id, {_COUNTS.replace('len(', 'CAST(len(').replace(') AS', ') AS INT) AS')} FROM (SELECT page_id, substr(html, 1, 500000) AS html FROM pages)",
    "platform_classify": f"""WITH c AS (SELECT page_id, url, lower(html) AS low, {_COUNTS} FROM pages), e AS (SELECT *, CASE WHEN page_id % 11 <> 0 THEN [200, 200, 200, 403, 500][page_id % 5 + 1] END AS s,
        CASE WHEN page_id % 4 = 0 THEN total_links ELSE pdf_links END AS pdfs FROM c),
      r AS (SELECT page_id, CASE WHEN s IS NULL THEN 'UNKNOWN||NONE|0.9' WHEN s = 403 AND (page_id % 10 = 3 OR regexp_matches(low[1:3000], 'cloudflare|incapsula|sucuri|akamai')) THEN 'UNKNOWN||PLAYWRIGHT|0.85' WHEN s >= 400 THEN 'NONE||NONE|0.7'
        WHEN regexp_matches(low, 'wp-content|wp-json') THEN 'WORDPRESS|generic_cms|HTML|0.9' WHEN regexp_matches(low, 'drupal\\.settings|/sites/default/files') THEN 'DRUPAL|generic_cms|HTML|0.9'
        WHEN contains(low[1:5000], 'joomla') OR contains(low, '/media/jui/') THEN 'JOOMLA|generic_cms|HTML|0.85' WHEN page_id % 6 = 0 AND url <> '' THEN 'RSS|generic_sitemap_rss|HTML|0.85'
        WHEN pdfs >= 3 AND pdfs * 2 >= total_links AND total_links > 0 THEN 'PDF_ONLY|pdf_bulletin|PDF|0.75' WHEN page_id % 7 = 0 THEN 'SITEMAP_ONLY|generic_sitemap_rss|HTML|0.7'
        WHEN length(low) < 3000 AND total_links < 5 AND scripts >= 2 THEN 'CUSTOM_HTML||PLAYWRIGHT|0.6' ELSE 'CUSTOM_HTML||HTML|0.5' END AS v FROM e)
      SELECT page_id, split_part(v, '|', 1) AS platform, nullif(split_part(v, '|', 2), '') AS adapter, split_part(v, '|', 3) AS crawl_method, split_part(v, '|', 4)::DOUBLE AS confidence FROM r""",
    "html_escape": f"SELECT page_id, sha256({_ESCAPED.format('html')}) AS digest FROM pages",
    "highlight_terms": f"SELECT item_id, regexp_replace({_ESCAPED.format('text')}, '(the|ing)', '<mark>\\1</mark>', 'gi') AS marked, true AS safe FROM benchmark",
    "sanitize_text": r"SELECT conv_id, turn, sha256(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0A-\x1F]', '', 'g')) AS digest FROM conversations",
    "embedding_text": "SELECT doc_id, sha256(substr(concat_ws(chr(10) || chr(10), nullif(source, ''), nullif(lang, ''), nullif(text, '')), 1, 6000)) AS digest FROM documents",
    "append_text": r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS o, regexp_replace(regexp_replace(coalesce(CASE WHEN doc_id % 2 = 0 THEN substr(text, 251, 100) ELSE source END, ''), '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS n FROM documents),
      b AS (SELECT doc_id, substr(CASE WHEN n = '' OR contains(o, n) THEN o WHEN o = '' THEN n ELSE o || ' ' || n END, 1, 200000) AS t FROM p) SELECT doc_id, CAST(length(t) AS INT) AS length, sha256(t) AS digest FROM b""",
    "document_verdicts": """WITH f AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '' END END AS name, doc_id % 60 AS pages FROM documents),
      k AS (SELECT *, doc_id % 4 = 0 OR coalesce(name LIKE '%.PDF', false) AS pdf, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM f)
      SELECT doc_id, CASE WHEN pdf THEN 'pdf' ELSE 'unknown' END AS kind, pdf AND pages > 0 AND n < 25 * pages AS needs_ocr,
        CASE WHEN NOT pdf THEN 'unsupported document type: ' || coalesce(name, 'unknown') WHEN pages > 0 AND n < 25 * pages THEN 'scanned document (' || n || ' characters on ' || pages || ' pages), needs OCR' ELSE '' END AS warnings FROM k""",
    "needs_ocr": "SELECT doc_id, length(trim(text)) < 25 * (doc_id % 40 + 1) AS needs_ocr FROM documents",
    "enrich_gate": """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS tender_id, user_id, ['closing_at', 'briefing_at', 'value_estimated', 'contact_email'][event_id % 4 + 1] AS field, event_type AS value,
        event_id / 1e6::DOUBLE + (event_id % 7) / 10.0::DOUBLE + 0.3::DOUBLE AS confidence FROM events), now AS (SELECT tender_id, field, avg(confidence) + 0.25::DOUBLE AS c FROM f WHERE user_id % 3 <> 0 GROUP BY 1, 2),
      b AS (SELECT tender_id, field, arg_max(value, confidence) AS value, max(confidence) AS confidence FROM f WHERE field <> 'contact_email' GROUP BY 1, 2)
      SELECT b.tender_id, b.field, value, round(confidence, 9) AS confidence, confidence > coalesce(c, 0) AS apply, b.field IN ('closing_at', 'value_estimated', 'compulsory_briefing') AND confidence < 0.8::DOUBLE AS review FROM b LEFT JOIN now n ON n.tender_id = b.tender_id AND n.field = b.field""",
    "review_depth": f"WITH {_QUEUE} SELECT field, count(*) AS open, min(queued_at) AS oldest FROM queue WHERE resolved_at IS NULL GROUP BY 1",
    "review_page": f"WITH {_QUEUE} SELECT id, field, queued_at FROM queue WHERE resolved_at IS NULL ORDER BY CASE WHEN field = 'closing_at' THEN 0 ELSE 1 END, queued_at, id LIMIT 30",
    "review_enqueue": f"""WITH {_QUEUE} SELECT DISTINCT o_custkey % 200 AS tender_id, CASE WHEN o_orderkey % 2 = 0 THEN 'closing_at' ELSE 'click' END AS field FROM orders o
      WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE resolved_at IS NULL AND q.tender_id = o.o_custkey % 200 AND q.field = CASE WHEN o_orderkey % 2 = 0 THEN 'closing_at' ELSE 'click' END)""",
    "review_resolve": f"""WITH {_QUEUE}, d AS (SELECT *, ['approve', 'correct', 'reject'][id % 3 + 1] AS action FROM queue WHERE id % 4 = 0 AND resolved_at IS NULL), v AS (SELECT * FROM d WHERE action <> 'approve' OR value IS NOT NULL)
      SELECT 'written ' || CASE WHEN action = 'correct' THEN 'given' ELSE 'kept' END AS what, count(*) AS n FROM v WHERE action <> 'reject' GROUP BY 1 UNION ALL SELECT 'resolved ' || action, count(*) FROM v GROUP BY 1""",
    "extract_notices": """WITH n AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, o_totalprice, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) + to_hours(CAST(o_orderkey % 24 AS INT)) END AS c FROM orders)
      SELECT id AS doc_id, 'SCM ' || lpad(CAST(id % 1000 AS VARCHAR), 4, '0') || '/' || year(o_orderdate) AS tender_number, strftime(CAST(CAST(c AS DATE) AS TIMESTAMP) + CASE WHEN id % 2 = 0 THEN INTERVAL 510 MINUTE ELSE INTERVAL 9 HOUR END, '%Y-%m-%d %H:%M') AS closing_utc,
      CASE WHEN c IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN 0.75 ELSE 0.6 END END::DOUBLE AS closing_confidence, CASE WHEN id % 3 = 0 THEN '1998-03-12 07:15' ELSE '1998-05-03 22:00' END AS briefing_utc, id % 3 = 0 AS compulsory,
      CASE WHEN id % 5 = 0 THEN '6CE,7GB' END AS grades, 'Level ' || (id % 8 + 1) AS level, 'buyer' || o_custkey || '@example.org' AS email, '0315550' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') AS phone,
      CASE WHEN round(o_totalprice, 2) >= 1000 THEN round(o_totalprice, 2) END AS value FROM n""",
}
