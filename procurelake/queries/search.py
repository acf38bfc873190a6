"""Queries on search and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions.vectors import cosine
from procurelake.plans import alerts as A
from procurelake.queries.tables import PROVINCE_NAMES, TENDER_AS_OF, tender_now, TENDER_SQL, table, tenders
from procurelake.search import match as M
from procurelake.search.parse import expand, synonym_index
from procurelake.search.store import IndexStore
from procurelake.search.trigrams import names_like, trigram_postings
from procurelake.search.vector_index import VectorLists
from procurelake.shared import apart, fresh_folder
from procurelake.streaming.alert_stream import counts_met, stored_clauses

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")

#: Synonyms among words that the invented prose has.
WORDS = "thing ering oning\nthe there\nedes anat\n"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", M.words_of("text").alias("words"))


def _find(spark, sf_dir, query, synonyms=None):
    terms = expand(query, synonym_index(synonyms or ""))
    return _docs(spark, sf_dir).where(M.matches(terms, F.col("words"))).select("id")


def keyword_match(spark, sf_dir):
    return _find(spark, sf_dir, "onan edes")


def keyword_negation(spark, sf_dir):
    return _find(spark, sf_dir, "edes -onan")


def synonym_match(spark, sf_dir):
    return _find(spark, sf_dir, "thing edes -oning", WORDS)


def synonym_titles(spark, sf_dir):
    """The engine's own synonyms on tender titles: delivery is asked for and supply is found, an item is left out."""
    terms = expand('delivery tender -road -"item 7"', synonym_index())
    titles = tenders(spark, sf_dir).select("id", M.words_of(F.concat_ws(" ", "title", F.when(F.col("id") % 4 == 0, F.lit("rfp")).otherwise(F.lit("other")))).alias("words"))
    return titles.where(M.matches(terms, F.col("words"))).select("id")


def phrase_match(spark, sf_dir):
    return _find(spark, sf_dir, '"attion to thanedble"')


def websearch_or(spark, sf_dir):
    return _docs(spark, sf_dir).where(M.matches_literal("onan or anat -edes", F.col("words"))).select("id")


def count_agreement(spark, sf_dir):
    found = _find(spark, sf_dir, "onan")
    return found.agg(F.count("*").alias("total"), F.min("id").alias("first_id"))


def postings_index(spark, sf_dir):
    docs = M.with_index(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), {"text": "B"})
    p = M.postings(docs)
    return p.select("lexeme", "id", F.size("positions").alias("n"), F.col("positions")[0]["pos"].alias("first_pos"))


def index_kept_up(spark, sf_dir):
    """An index of all documents, of which a third get another text, a seventh go, some come anew and some come back, merged in between: what a search finds then."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    store = IndexStore(spark, fresh_folder(spark, "index"), docs.schema, {"text": "B"})
    store.change(docs.where("id % 4 != 1"))
    store.change(docs.where("id % 3 = 0").withColumn("text", F.concat(F.lit("onan "), "text")), docs.where("id % 7 = 0").select("id"))
    store.merge()
    store.remove_merged()
    store.change(docs.where("id % 4 = 1"))
    store.change(docs.where("id % 14 = 0"), docs.where("id % 11 = 0").select("id"))
    return M.matching_ids(store.postings(), expand("onan edes", {}))


def _asking(spark, sf_dir):
    """Every customer's alert: words, provinces, categories and a window, each for some."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    words = F.concat(F.lit("item "), (k % 50).cast("string"), F.when(k % 4 == 0, F.lit(" -urgent")).otherwise(F.lit("")))
    return c.select(
        k.alias("alert_id"), F.when(k % 3 != 0, words).alias("keywords"), F.when(k % 2 == 0, F.array(F.element_at(F.array(*map(F.lit, PROVINCE_NAMES)), (k % 9 + 1).cast("int")))).alias("provinces"),
        F.when(k % 5 != 0, F.array(F.get(F.array(*map(F.lit, PRIORITIES)), (k % 5 - 1).cast("int")), F.lit("none"))).alias("categories"), F.when(k % 10 == 1, 900).alias("closing_within_days"), (k % 13 != 0).alias("active"),
    )


def alert_clauses_met(spark, sf_dir):
    """How many tenders every customer's alert meets, by the stored clauses that the alert stream uses, and the first and last of them."""
    alerts = _asking(spark, sf_dir).withColumn("asked", F.xxhash64(F.to_json(F.struct("keywords", "provinces", "categories", "closing_within_days", "active"))))
    once = alerts.groupBy("asked").agg(*[F.min(c).alias(c) for c in ("keywords", "provinces", "categories", "closing_within_days", "active")]).withColumnRenamed("asked", "alert_id")
    t = _alert_tenders(spark, sf_dir).withColumn("categories", F.array("title_head"))
    counts = counts_met(t, stored_clauses(once, A.word_frequencies(t)), tender_now())
    return alerts.join(counts.withColumnRenamed("alert_id", "asked"), "asked").select("alert_id", "n", "first_id", "last_id")


def _vector(spark):
    return F.array(*[F.lit(float((i * 37) % 11 - 5)) for i in range(64)])


def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine("embedding", _vector(spark)), 9).alias("similarity"))
    return e.orderBy(F.col("similarity").desc(), "vec_id").limit(20)


def urgency_score(spark, sf_dir):
    return tenders(spark, sf_dir).select("id", F.round(M.urgency("closing_at", tender_now()), 9).alias("urgency"))


def hybrid_score(spark, sf_dir):
    t = tenders(spark, sf_dir)
    keyword = (F.col("id") % 8) / F.lit(8.0)
    similarity = (F.col("id") % 6) / F.lit(6.0)
    plain = M.composite_score(keyword, M.authority("authority_score"), M.urgency("closing_at", tender_now()))
    both = M.composite_score(keyword, M.authority("authority_score"), M.urgency("closing_at", tender_now()), similarity)
    return t.select("id", F.round(plain, 10).alias("score"), F.round(both, 10).alias("hybrid"))


def buyer_ilike(spark, sf_dir):
    return tenders(spark, sf_dir).where(M.filters(buyer="CUSTOMER#12%4")).select("id", "buyer_name")


def buyer_trigrams(spark, sf_dir):
    """Tenders of the buyers that a pattern finds, by the trigrams of the buyers' names."""
    t = tenders(spark, sf_dir).select("id", "buyer_name")
    stored = trigram_postings(t, "buyer_name")
    found = names_like(stored, t, "%tomer#1_2%", "buyer_name")
    return t.join(apart(found.withColumnRenamed("name", "buyer_name"), "buyer_name"), "buyer_name").select("id", "buyer_name")


def vector_lists_exact(spark, sf_dir):
    """Every fiftieth vector against all, by the stored lists, all of them asked."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorLists(spark, fresh_folder(spark, "vectors"), "vec_id").build(e)
    found = index.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), 10, None)
    return found.groupBy("query").agg(F.count("*").alias("n"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"))


def vector_lists_probed(spark, sf_dir):
    """The same with the nearest lists only; what it finds is in the result above, its recall is tested."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorLists(spark, fresh_folder(spark, "vectors"), "vec_id").build(e)
    return index.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), 10).select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def browse_order_page(spark, sf_dir):
    t = tenders(spark, sf_dir)
    return t.orderBy(*M.browse_order()).offset(40).limit(20).select("id", "closing_at", "authority_score", "published_at")


def filter_compose_page(spark, sf_dir):
    f = M.filters(province="Gauteng", status="open", compulsory=False, closing_within_days=400, as_of=tender_now())
    return tenders(spark, sf_dir).where(f).orderBy(*M.browse_order()).limit(50).select("id", "province", "status", "closing_at")


def search_page(spark, sf_dir):
    """A whole search with rank and highlights; cover density and stems have no SQL."""
    rows = tenders(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id")  # a table of one small file is one task
    t, stored = M.stored_index(rows, {"title": "A", "tender_number": "A", "buyer_name": "B"}, stemmed=True)
    page = M.search(t, "supply item", F.lit(TENDER_AS_OF).cast("timestamp_ntz"), limit=50, stemmed=True, stored=stored)
    shown = M.with_headline(page, "supply item", body="buyer_name")
    return shown.select("id", "title", F.round("score", 9).alias("score"), "title_highlight", "snippet")


def _alerts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0")
    none = F.lit(None)
    return c.select(
        F.col("c_custkey").alias("alert_id"), F.when(F.col("c_custkey") % 100 == 0, F.concat(F.lit("item "), (F.col("c_custkey") % 50 + F.col("c_nationkey")).cast("string"))).alias("keywords"),
        F.when(F.col("c_custkey") % 100 != 0, F.array(F.lit("Gauteng"), F.lit("Limpopo"))).alias("provinces"), none.cast("array<string>").alias("categories"),
        F.when(F.col("c_custkey") % 150 != 0, 90).alias("closing_within_days"), (F.col("c_custkey") % 350 != 0).alias("active"),
    )


def _alert_tenders(spark, sf_dir):
    t = M.with_index(tenders(spark, sf_dir), {"title": "A"})
    prov = F.create_map(F.lit("closing_at"), F.struct(F.lit("SOURCE").alias("source"), F.lit("s").alias("source_id"), F.col("closing_confidence").alias("confidence"), F.lit(None).cast("string").alias("note")))
    t = t.withColumn("title_head", F.element_at(F.split("title", " supply"), 1))
    return t.withColumns({"field_provenance": prov, "categories": F.array().cast("array<string>"), "created_at": F.col("published_at")})


def _sent(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select((F.col("o_orderkey") % 30 * 50).alias("alert_id"), F.col("o_orderkey").alias("tender_id"))


def alert_match_topk(spark, sf_dir):
    return A.match_alerts(_alerts(spark, sf_dir), _alert_tenders(spark, sf_dir), _sent(spark, sf_dir), tender_now())


def alert_anti_join(spark, sf_dir):
    a, t = _alerts(spark, sf_dir).select("alert_id"), tenders(spark, sf_dir).where("status = 'OPEN'").select(F.col("id").alias("tender_id"), (F.col("id") % 30 * 50).alias("alert_id"))
    return t.join(a, "alert_id").join(_sent(spark, sf_dir), ["alert_id", "tender_id"], "left_anti")


def alert_totals(spark, sf_dir):
    events = _sent(spark, sf_dir).withColumn("sent_at", F.col("tender_id"))
    return A.alert_totals(_alerts(spark, sf_dir).select("alert_id"), events)


def alert_digests(spark, sf_dir):
    t = _alert_tenders(spark, sf_dir)
    matched = A.match_alerts(_alerts(spark, sf_dir), t, _sent(spark, sf_dir), tender_now())
    return A.digests(matched, t.withColumn("closing_at", F.col("closing_at").cast("timestamp"))).select("alert_id", "n", F.length("body").alias("length"), F.sha2("body", 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_match, keyword_negation, synonym_match, synonym_titles, phrase_match, websearch_or, count_agreement, postings_index, cosine_topk, urgency_score, hybrid_score, buyer_ilike,
        browse_order_page, filter_compose_page, search_page, alert_match_topk, alert_anti_join, alert_totals, alert_digests, alert_clauses_met, index_kept_up, buyer_trigrams, vector_lists_exact, vector_lists_probed,
    )
}

_W = r"docs AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}_]+)', 1) AS w FROM documents)"
_HAS = "list_contains(w, '{}')"
_U = f"""CASE WHEN closing_at IS NULL THEN 0.15 WHEN closing_at <= TIMESTAMP '{TENDER_AS_OF}' THEN 0.0 WHEN closing_at < TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 12 HOUR THEN 0.35
  WHEN closing_at < TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 30 DAY THEN 1.0::DOUBLE - epoch_us(closing_at - TIMESTAMP '{TENDER_AS_OF}') / 1e6 / 2592000.0 ELSE 0.1 END::DOUBLE"""
_VECTOR = "[" + ", ".join(f"{float((i * 37) % 11 - 5)}" for i in range(64)) + "]::DOUBLE[]"
_ALERTS = """alerts AS (SELECT c_custkey AS alert_id, CASE WHEN c_custkey % 100 = 0 THEN 'item ' || (c_custkey % 50 + c_nationkey) END AS keywords, c_custkey % 100 <> 0 AS by_province,
  CASE WHEN c_custkey % 150 <> 0 THEN 90 END AS days, c_custkey % 350 <> 0 AS active FROM customer WHERE c_custkey % 50 = 0),
sent AS (SELECT o_orderkey % 30 * 50 AS alert_id, o_orderkey AS tender_id FROM orders WHERE o_orderkey % 9 = 0)"""
_MATCHED = f"""{_ALERTS}, met AS (SELECT alert_id, id AS tender_id, closing_at, published_at, closing_confidence, title FROM alerts JOIN tenders t ON active AND status IN ('OPEN', 'CLOSING_SOON')
  AND (CASE WHEN by_province THEN province IN ('Gauteng', 'Limpopo') ELSE list_has_all(regexp_extract_all(lower(title), '[a-z0-9]+'), ['item', substr(keywords, 6)]) END)
  AND (days IS NULL OR (closing_confidence >= 0.8::DOUBLE AND closing_at BETWEEN TIMESTAMP '{TENDER_AS_OF}' AND TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 90 DAY))
  WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.alert_id = alerts.alert_id AND s.tender_id = t.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY closing_at NULLS LAST, published_at DESC, tender_id) AS rank FROM met)"""

ORACLE_SQL = {
    "buyer_trigrams": f"WITH {TENDER_SQL} SELECT id, buyer_name FROM tenders WHERE buyer_name ILIKE '%tomer#1_2%'",
    "vector_lists_exact": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
      s AS (SELECT a.vec_id AS query, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM u a JOIN u b ON a.vec_id % 50 = 0 WHERE a.n > 0 AND b.n > 0),
      r AS (SELECT query, c, row_number() OVER (PARTITION BY query ORDER BY c DESC) AS k FROM s) SELECT query, count(*) AS n, round(min(c), 6) AS least, round(max(c), 6) AS most FROM r WHERE k <= 10 GROUP BY 1""",
    "index_kept_up": f"WITH {_W}, kept AS (SELECT id, w, id % 14 = 0 OR id % 4 = 1 AS plain FROM docs WHERE id % 11 <> 0 OR id % 4 = 1 AND id % 14 <> 0 AND id % 11 <> 0), there AS (SELECT * FROM kept WHERE id % 14 = 0 OR id % 4 = 1 OR id % 7 <> 0) SELECT id FROM there WHERE {_HAS.format('edes')} AND ({_HAS.format('onan')} OR (NOT plain AND id % 3 = 0))",
    "alert_clauses_met": f"""WITH {TENDER_SQL}, asking AS (SELECT c_custkey AS alert_id, c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 5 <> 0)),
      t AS (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS w, string_split(title, ' supply')[1] AS head FROM tenders WHERE status IN ('OPEN', 'CLOSING_SOON'))
      SELECT alert_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM asking JOIN t ON (k % 3 = 0 OR (list_has_all(w, ['item', CAST(k % 50 AS VARCHAR)]) AND (k % 4 <> 0 OR NOT list_contains(w, 'urgent'))))
        AND (k % 2 <> 0 OR province = {list(PROVINCE_NAMES)}[k % 9 + 1]) AND (k % 5 = 0 OR head = {list(PRIORITIES)}[k % 5])
        AND (k % 10 <> 1 OR (closing_confidence >= 0.8::DOUBLE AND closing_at BETWEEN TIMESTAMP '{TENDER_AS_OF}' AND TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 900 DAY)) GROUP BY 1""",
    "keyword_match": f"WITH {_W} SELECT id FROM docs WHERE {_HAS.format('onan')} AND {_HAS.format('edes')}",
    "keyword_negation": f"WITH {_W} SELECT id FROM docs WHERE {_HAS.format('edes')} AND NOT {_HAS.format('onan')}",
    "synonym_match": f"WITH {_W} SELECT id FROM docs WHERE ({_HAS.format('thing')} OR {_HAS.format('ering')} OR {_HAS.format('oning')}) AND ({_HAS.format('edes')} OR {_HAS.format('anat')}) AND NOT {_HAS.format('oning')}",
    "synonym_titles": f"WITH {TENDER_SQL} SELECT id FROM tenders WHERE id % 4 = 0 AND id % 50 <> 7",
    "phrase_match": f"WITH {_W} SELECT id FROM docs WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' attion to thanedble ')",
    "websearch_or": f"WITH {_W} SELECT id FROM docs WHERE {_HAS.format('onan')} OR ({_HAS.format('anat')} AND NOT {_HAS.format('edes')})",
    "count_agreement": f"WITH {_W} SELECT count(*) AS total, min(id) AS first_id FROM docs WHERE {_HAS.format('onan')}",
    "postings_index": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}_]+)', 1) AS ws FROM documents), f AS (SELECT id, unnest(ws) AS lexeme, generate_subscripts(ws, 1) AS pos FROM w)
      SELECT lexeme, id, CAST(count(*) AS INT) AS n, CAST(min(pos) AS INT) AS first_pos FROM f GROUP BY 1, 2""",
    "cosine_topk": f"""WITH s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_VECTOR}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_VECTOR}, {_VECTOR}))), 9) AS similarity FROM embeddings)
      SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 20""",
    "urgency_score": f"WITH {TENDER_SQL} SELECT id, round({_U}, 9) AS urgency FROM tenders",
    "hybrid_score": f"""WITH {TENDER_SQL}, p AS (SELECT id, (id % 8) / 8.0::DOUBLE AS k, (id % 6) / 6.0::DOUBLE AS v, coalesce(authority_score, 50) / 100.0::DOUBLE AS a, {_U} AS u FROM tenders)
      SELECT id, round(0.625::DOUBLE * k + 0.1562::DOUBLE * a + 0.2187::DOUBLE * u, 10) AS score, round(0.4545::DOUBLE * k + 0.1136::DOUBLE * a + 0.1591::DOUBLE * u + 0.2727::DOUBLE * v, 10) AS hybrid FROM p""",
    "buyer_ilike": f"WITH {TENDER_SQL} SELECT id, buyer_name FROM tenders WHERE buyer_name ILIKE '%CUSTOMER#12%4%'",
    "browse_order_page": f"WITH {TENDER_SQL} SELECT id, closing_at, authority_score, published_at FROM tenders ORDER BY closing_at NULLS LAST, coalesce(authority_score, 50) DESC, published_at DESC NULLS LAST, id LIMIT 20 OFFSET 40",
    "filter_compose_page": f"""WITH {TENDER_SQL} SELECT id, province, status, closing_at FROM tenders WHERE province = 'Gauteng' AND status = 'OPEN' AND compulsory_briefing = false
      AND closing_at BETWEEN TIMESTAMP '{TENDER_AS_OF}' AND TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 400 DAY ORDER BY closing_at NULLS LAST, coalesce(authority_score, 50) DESC, published_at DESC NULLS LAST, id LIMIT 50""",
    "alert_match_topk": f"WITH {TENDER_SQL}, {_MATCHED} SELECT alert_id, tender_id, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 25",
    "alert_anti_join": f"WITH {TENDER_SQL}, {_ALERTS} SELECT id % 30 * 50 AS alert_id, id AS tender_id FROM tenders t JOIN alerts a ON a.alert_id = id % 30 * 50 WHERE status = 'OPEN' AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.alert_id = a.alert_id AND s.tender_id = t.id)",
    "alert_totals": f"WITH {_ALERTS} SELECT a.alert_id, count(s.tender_id) AS sent, max(s.tender_id) AS last_sent FROM alerts a LEFT JOIN sent s ON s.alert_id = a.alert_id GROUP BY 1",
    "alert_digests": f"""WITH {TENDER_SQL}, {_MATCHED}, body AS (SELECT alert_id, count(*) AS n, string_agg(title || ' | ' || CASE WHEN closing_at IS NULL OR closing_confidence < 0.8::DOUBLE THEN 'closing date unverified - check at source'
      ELSE 'closes ' || strftime(closing_at + INTERVAL 2 HOUR, '%d %b %Y, %H:%M') || ' SAST' END, chr(10) ORDER BY rank) AS body FROM ranked WHERE rank <= 25 GROUP BY 1)
      SELECT alert_id, n, CAST(length(body) AS INT) AS length, sha256(body) AS digest FROM body""",
}
