"""Queries on notices: keys, times, duplicates, versions, merging, shaping, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions import keys as K
from procurelake.functions import times as T
from procurelake.operators import dedupe as D
from procurelake.operators import normalize as N
from procurelake.operators import versions as V
from procurelake.operators.growing import GrowingClusters
from procurelake.operators.stores import TenderStore, UniqueTable
from procurelake.plans import schedule, stats
from procurelake.queries.tables import TENDER_AS_OF, tender_now, TENDER_SQL, table, tenders
from procurelake.shared import fresh_folder, stash
from procurelake.sources.ocds import month_windows as windows
from procurelake.sources.ocds import windows_of


STORED_UNTIL = "1996-01-01"


def norm_number(spark, sf_dir):
    t = tenders(spark, sf_dir)
    return t.select("id", "tender_number", K.tender_number_key("tender_number").alias("number_key"))


def norm_org(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("The City of "), "c_name", F.lit(" Metropolitan Municipality")).alias("name"))
    return c.select("c_custkey", "name", K.org_key("name").alias("org_key"))


def _keyed(spark, sf_dir):
    return tenders(spark, sf_dir).withColumns(
        {"buyer_key": K.org_key("buyer_name"), "normalized_tender_number": K.tender_number_key("tender_number"), "closing_day": F.col("closing_at").cast("date")}
    ).withColumn("fingerprint", K.fingerprint("buyer_key", "normalized_tender_number", "title", F.col("closing_day")))


def fingerprint_sha(spark, sf_dir):
    return _keyed(spark, sf_dir).select("id", "fingerprint")


def natural_key_dedupe(spark, sf_dir):
    t = _keyed(spark, sf_dir).select("id", K.natural_key("buyer_key", "normalized_tender_number").alias("natural_key"))
    return t.groupBy("natural_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _days(spark, sf_dir):
    """Tenders with titles and days coarse enough for fuzzy duplicates: one buyer per nation."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("buyer_org_id"), F.col("c_nationkey").cast("string").alias("nation"))
    k = _keyed(spark, sf_dir).join(t, "buyer_org_id")
    return k.withColumn("buyer_key", F.col("nation")).withColumn("closing_day", F.trunc("closing_day", "month"))


def duplicate_clusters(spark, sf_dir):
    t = _keyed(spark, sf_dir).select("id", "fingerprint", "buyer_key", "normalized_tender_number", "closing_day", "title")
    return D.clusters(t, D.duplicate_links(t))


def clusters_over_time(spark, sf_dir):
    """The links between duplicates added to stored clusters in three batches; every node's cluster after the last."""
    links = D.duplicate_links(_keyed(spark, sf_dir).select("id", "fingerprint", "buyer_key", "normalized_tender_number", "closing_day", "title"))
    links = stash(links, "links")
    store = GrowingClusters(spark, fresh_folder(spark, "clusters"), buckets=8)
    for part in (2, 0, 1):
        store.add(links.where(F.col("b") % 3 == part))
    return store.clusters()


def jaccard_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(K.title_similarity("p_name", "p_type"), 6).alias("similarity"), K.titles_similar("p_name", F.concat("p_name", F.lit(" x"))).alias("similar"))


def authority_merge(spark, sf_dir):
    t = tenders(spark, sf_dir).select(
        "id", (F.col("id") % 500).alias("cluster"), "authority_score", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source_id"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")).alias("title"), "province", "closing_at", "value_estimated",
    )
    m = D.merge_by_authority(t)
    return m.select("cluster", "id", "authority_score", "members", "title", "province", "closing_at", "value_estimated", F.size("conflicts").alias("n_conflicts"))


def _pairs(spark, sf_dir):
    """Each tender beside the buyer's next one, as an old and a new state of one record."""
    from pyspark.sql import Window

    fields = [f for f in V.TRACKED if f in tenders(spark, sf_dir).columns]
    w = Window.partitionBy("buyer_org_id").orderBy("published_at", "id")
    t = tenders(spark, sf_dir).withColumn("province", F.when(F.col("id") % 7 != 0, F.col("province")))
    cols = F.struct(*fields)
    return t.select("id", F.lag(cols).over(w).alias("old"), cols.alias("new")).where("old is not null")


def version_diff(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    d = p.select("id", V.field_changes(p, "old", "new").alias("changes"))
    return d.select("id", F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"), F.size("changes").alias("n_changes"))


def change_kind(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    d = p.withColumn("changes", V.field_changes(p, "old", "new"))
    kind = d.select(V.change_kind("changes", "old.closing_at", "new.closing_at").alias("kind"))
    return kind.groupBy("kind").agg(F.count("*").alias("n"))


def insert_ignore(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ocid"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("release_id"), F.col("o_orderkey").alias("id"))
    return V.insert_ignore(o.where("id % 4 = 0"), o.where("id % 4 != 0"), ["ocid", "release_id"], "id").select("ocid", "release_id", "id")


def coalesce_update(spark, sf_dir):
    """Upsert of later orders into the first per customer; the state after it."""
    t = tenders(spark, sf_dir)
    shaped = t.select(F.col("buyer_org_id").alias("tender_id"), F.concat(F.lit("k"), F.col("buyer_org_id").cast("string")).alias("natural_key"), F.concat(F.lit("f"), F.col("buyer_org_id").cast("string")).alias("fingerprint"), "title", "province", "closing_at", "status", F.col("id").alias("seen_at"))
    first = V.latest_wins(shaped.withColumn("__neg", -F.col("seen_at")), ["tender_id"], "__neg").drop("__neg")
    stored = first.drop("seen_at").withColumn("version_no", F.lit(1))
    later = shaped.join(first.select("tender_id", "seen_at"), ["tender_id", "seen_at"], "left_anti").drop("tender_id")
    state, _ = V.upsert(stored, later)
    return state.select("tender_id", "version_no", "title", "province", "closing_at", "status")


def upsert_versions(spark, sf_dir):
    """The version rows of the same upsert, counted by kind."""
    t = tenders(spark, sf_dir)
    shaped = t.select(F.concat(F.lit("k"), F.col("buyer_org_id").cast("string")).alias("natural_key"), F.concat(F.lit("f"), F.col("buyer_org_id").cast("string")).alias("fingerprint"), "title", "closing_at", "status", F.col("id").alias("seen_at"))
    none = shaped.select(F.lit("").alias("tender_id"), F.lit(0).alias("version_no"), "*").drop("seen_at").where("false")
    _, versions = V.upsert(none, shaped)
    return versions.groupBy("kind").agg(F.count("*").alias("n"), F.max("version_no").alias("top"))


def upsert_identity(spark, sf_dir):
    """Arrivals of which a third has no natural key: they meet the others of the batch, and stored tenders, by fingerprint; what is not tracked is folded too."""
    t = tenders(spark, sf_dir)
    buyer = F.col("buyer_org_id").cast("string")
    shaped = t.select(
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), buyer)).alias("natural_key"), F.concat(F.lit("f"), buyer, F.lit("-"), (F.col("id") % 8 % 5).cast("string")).alias("fingerprint"), "title", "status",
        "authority_score", F.array(F.concat(F.lit("u"), (F.col("id") % 4).cast("string"))).alias("source_urls"), F.col("id").alias("seen_at"),
    )
    stored = t.where("id % 7 = 0").groupBy("buyer_org_id").agg(F.min("id").alias("first")).select(
        F.concat(F.lit("s"), F.col("buyer_org_id").cast("string")).alias("tender_id"), F.lit(None).cast("string").alias("natural_key"), F.concat(F.lit("f"), F.col("buyer_org_id").cast("string"), F.lit("-0")).alias("fingerprint"),
        F.lit(1).alias("version_no"), F.lit("stored").alias("title"), F.lit("OPEN").alias("status"), F.lit(50).alias("authority_score"), F.array(F.lit("u9"), F.lit("u1")).alias("source_urls"),
    )
    state, _ = V.upsert(stored, shaped)
    return state.select("tender_id", "natural_key", "fingerprint", "version_no", "title", "status", "authority_score", F.array_join("source_urls", ",").alias("urls"))


def archived_once(spark, sf_dir):
    """Three batches of releases into a stored table with a unique key, the second of them twice; what is stored after."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ocid"), F.col("o_orderpriority").alias("release_id"), F.col("o_orderkey").alias("id"))
    store = UniqueTable(spark, fresh_folder(spark, "archive"), o.schema, ["ocid", "release_id"], buckets=8)
    for part in (0, 1, 1, 2):
        store.insert(o.where(F.col("id") % 3 == part), "id")
    return store.all()


def stored_state(spark, sf_dir):
    """Tenders folded into a store in two batches by publishing date, the second of them twice; the state after it."""
    t = tenders(spark, sf_dir)
    buyer = F.col("buyer_org_id").cast("string")
    shaped = t.select(F.concat(F.lit("k"), buyer).alias("natural_key"), F.concat(F.lit("f"), buyer).alias("fingerprint"), "title", "status", "authority_score", F.struct("published_at", "id").alias("seen_at"))
    store = TenderStore(spark, fresh_folder(spark, "tenders"), shaped.drop("seen_at").schema, buckets=8)
    day = F.col("seen_at.published_at") < F.lit(STORED_UNTIL).cast("date")
    for number, part in ((0, day), (1, ~day), (1, ~day)):
        store.upsert(shaped.where(part), number, F.lit(f"2026-01-0{number + 1}"))
    return store.tenders().select("natural_key", "version_no", "title", "status", "authority_score", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def resolve_buyers(spark, sf_dir):
    """Suppliers' nations as buyers, against aliases of the even nations only."""
    n = table(spark, sf_dir, "nation")
    aliases = n.where("n_nationkey % 2 = 0").select(K.org_key("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("org_id"))
    t = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("The "), F.initcap("n_name")).alias("buyer_name"))
    resolved, _ = V.resolve_buyers(t, aliases)
    return resolved.select("s_suppkey", "buyer_name", F.when(F.length("buyer_org_id") < 10, F.col("buyer_org_id")).alias("known_org"), (F.length("buyer_org_id") == 64).alias("made"))


def wall_time_sast(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit(""), F.lit("+0000")), (F.col("event_id") % 4 + 1).cast("int"))).alias("said"))
    at, fixed = T.parse_wall_time("said")
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc"), fixed.alias("corrected"))


def date_only_rule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 3 * 11).cast("int"))).cast("timestamp").alias("closing"))
    return o.select("o_orderkey", T.looks_date_only("closing").alias("date_only"), F.date_format(T.closing_with_default_hour("closing"), "yyyy-MM-dd HH:mm:ss").alias("closing"))


def month_windows(spark, sf_dir):
    return windows(spark, "2023-11-15", "2025-02-10")


def buyer_windows(spark, sf_dir):
    """The months between each buyer's first and last notice, as windows to read again."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("buyer_org_id")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    return windows_of(o)


def closing_status(spark, sf_dir):
    t = tenders(spark, sf_dir)
    state = N.tender_status("closing_at", "closing_confidence", tender_now(), F.col("id") % 17 == 0, F.col("id") % 19 == 0)
    return t.select("id", state.alias("status_now"))


def shape_rows(spark, sf_dir):
    t = tenders(spark, sf_dir)
    kind = F.when(F.col("id") % 2 == 0, "SOURCE").otherwise("INFERRED")
    prov = F.create_map(F.lit("closing_at"), N.provenance(kind, F.lit("s"), 0.0, F.lit("assumed")).withField("confidence", F.col("closing_confidence")))
    s = N.shape_tenders(t.withColumns({"field_provenance": prov, "source_urls": F.array(F.concat(F.lit("u/"), F.col("id").cast("string")))}))
    return s.select("id", F.col("buyer.name").alias("buyer_name"), F.col("closing.verified").alias("verified"), F.col("closing.note").alias("note"), F.col("closing.verify_at_source").alias("verify_at_source"))


def low_confidence_routing(spark, sf_dir):
    t = tenders(spark, sf_dir)
    entry = lambda c: N.provenance(F.lit("SOURCE"), F.lit("s"), 0.0, F.lit(None).cast("string")).withField("confidence", c)
    prov = F.create_map(F.lit("title"), entry(F.lit(0.1)), F.lit("closing_at"), entry(F.col("closing_confidence")))
    return t.select("id", F.explode(N.review_items(prov)).alias("r")).select("id", F.col("r.field").alias("field"), F.round("r.confidence", 6).alias("confidence"))


def date_quarantine(spark, sf_dir):
    t = tenders(spark, sf_dir).withColumn("closing_at", F.col("closing_at") - F.expr("INTERVAL 10 DAYS"))
    return N.quarantine(t)[1].select("id", "published_at", "closing_at")


def stats_by_group(spark, sf_dir):
    return stats.stats(tenders(spark, sf_dir))


def open_tenders(spark, sf_dir):
    return stats.open_count(tenders(spark, sf_dir))


def table_counts(spark, sf_dir):
    return stats.table_counts({n: table(spark, sf_dir, n) for n in ("orders", "customer", "events", "documents")})


def lateral_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ocid"), F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("archived_at"), "o_totalprice")
    return schedule.latest_archive(o)


def version_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tender_id"), "o_orderkey")
    old = o.where("o_orderkey % 3 = 0").groupBy("tender_id").agg(F.count("*").cast("int").alias("version_no"))
    return schedule.next_versions(old, o.where("o_orderkey % 3 != 0"), "tender_id", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        norm_number, norm_org, fingerprint_sha, natural_key_dedupe, duplicate_clusters, clusters_over_time, jaccard_titles, authority_merge, version_diff, change_kind, insert_ignore, coalesce_update, upsert_versions, upsert_identity, archived_once, stored_state, resolve_buyers,
        wall_time_sast, date_only_rule, month_windows, buyer_windows, closing_status, shape_rows, low_confidence_routing, date_quarantine, stats_by_group, open_tenders, table_counts, lateral_latest, version_numbers,
    )
}

_WITH = f"WITH {TENDER_SQL}"
_NUMBER = r"regexp_replace(regexp_replace(lower(trim(tender_number)), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '[\s/\-.:()_,;#|\\]+', '', 'g')"
_ORG = "regexp_replace(regexp_replace(lower({0}), '\\b(?:metropolitan municipality|metro municipality|local municipality|district municipality|municipality|city of|province of|provincial government|government of|the)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
_BUYER = _ORG.format("buyer_name")
_TITLE = "substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 120)"
_KEYED = f"{_WITH}, keyed AS (SELECT *, {_BUYER} AS buyer_key, {_NUMBER} AS number_key, CAST(closing_at AS DATE) AS day FROM tenders)"
_PRINT = f"sha256(buyer_key || '|' || number_key || '|' || {_TITLE} || '|' || coalesce(strftime(day, '%Y-%m-%d'), ''))"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_FIELDS = ("title", "tender_number", "buyer_name", "province", "status", "published_at", "closing_at", "compulsory_briefing", "value_estimated")
_PAIRS = f"""{_WITH}, t AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN province END AS province) FROM tenders),
pairs AS (SELECT id, {", ".join(f"{f} AS n_{f}, lag({f}) OVER w AS o_{f}" for f in _FIELDS)}, lag(id) OVER w AS o_id FROM t WINDOW w AS (PARTITION BY buyer_org_id ORDER BY published_at, id)),
diffs AS (SELECT *, list_filter([{", ".join(f"CASE WHEN n_{f} IS NOT NULL AND n_{f} IS DISTINCT FROM o_{f} THEN '{f}' END" for f in _FIELDS)}], lambda x: x IS NOT NULL) AS fields FROM pairs WHERE o_id IS NOT NULL)"""
_MERGE = ", ".join(f"arg_min({f}, CASE WHEN {f} IS NOT NULL THEN k END) AS {f}" for f in ("title", "province", "closing_at", "value_estimated"))

ORACLE_SQL = {
    "norm_number": f"{_WITH} SELECT id, tender_number, {_NUMBER} AS number_key FROM tenders",
    "norm_org": f"SELECT c_custkey, 'The City of ' || c_name || ' Metropolitan Municipality' AS name, {_ORG.format(chr(39) + 'The City of ' + chr(39) + ' || c_name || ' + chr(39) + ' Metropolitan Municipality' + chr(39))} AS org_key FROM customer",
    "fingerprint_sha": f"{_KEYED} SELECT id, {_PRINT} AS fingerprint FROM keyed",
    "natural_key_dedupe": f"{_KEYED} SELECT buyer_key || '|' || number_key AS natural_key, count(*) AS n, min(id) AS first_id FROM keyed GROUP BY 1",
    "duplicate_clusters": f"""WITH RECURSIVE {TENDER_SQL}, keyed AS (SELECT *, {_BUYER} AS buyer_key, {_NUMBER} AS number_key, CAST(closing_at AS DATE) AS day, {_WORDS.format("title")} AS w FROM tenders),
      pairs AS (SELECT a.id AS x, b.id AS y FROM keyed a JOIN keyed b ON a.buyer_key = b.buyer_key AND a.id <> b.id WHERE a.number_key = b.number_key OR
        (a.day = b.day AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6)),
      reach AS (SELECT id AS x, id AS y FROM keyed UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y)
      SELECT x AS id, min(y) AS cluster FROM reach GROUP BY 1""",
    "jaccard_titles": f"""SELECT p_partkey, round(len(list_intersect({_WORDS.format("p_name")}, {_WORDS.format("p_type")})) / len(list_distinct(list_concat({_WORDS.format("p_name")}, {_WORDS.format("p_type")})))::DOUBLE, 6) AS similarity,
      len({_WORDS.format("p_name")}) / len(list_distinct(list_concat({_WORDS.format("p_name")}, ['x'])))::DOUBLE >= 0.6 AS similar FROM part""",
    "authority_merge": f"""{_WITH}, t AS (SELECT id, id % 500 AS cluster, authority_score, CASE WHEN id % 3 <> 0 THEN title END AS title, province, closing_at, value_estimated FROM tenders),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY authority_score DESC, id) AS k FROM t),
      best AS (SELECT cluster, arg_min(id, k) AS id, max(authority_score) AS authority_score, count(*) AS members, {_MERGE} FROM r GROUP BY 1),
      lost AS (SELECT cluster, {" + ".join(f"count(*) FILTER (r.{f} <> b.{f})" for f in ("title", "province", "closing_at", "value_estimated"))} AS n FROM r JOIN best b USING (cluster) GROUP BY 1)
      SELECT b.*, CAST(n AS INT) AS n_conflicts FROM best b JOIN lost USING (cluster)""",
    "version_diff": f"{_PAIRS} SELECT id, array_to_string(fields, ',') AS fields, CAST(len(fields) AS INT) AS n_changes FROM diffs",
    "change_kind": f"""{_PAIRS} SELECT CASE WHEN len(fields) = 0 THEN NULL WHEN list_contains(fields, 'status') AND n_status = 'CANCELLED' THEN 'CANCELLED' WHEN list_contains(fields, 'closing_at') AND n_closing_at > o_closing_at THEN 'EXTENDED'
      WHEN list_contains(fields, 'closing_at') AND n_closing_at < o_closing_at THEN 'SHORTENED' ELSE 'DETAILS_CHANGED' END AS kind, count(*) AS n FROM diffs GROUP BY 1""",
    "insert_ignore": """WITH o AS (SELECT o_custkey AS ocid, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS release_id, o_orderkey AS id FROM orders),
      fresh AS (SELECT *, row_number() OVER (PARTITION BY ocid, release_id ORDER BY id) AS k FROM o i WHERE id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM o e WHERE e.id % 4 = 0 AND e.ocid = i.ocid AND e.release_id = i.release_id))
      SELECT ocid, release_id, id FROM fresh WHERE k = 1 OR release_id IS NULL""",
    "coalesce_update": f"""{_WITH}, s AS (SELECT buyer_org_id AS tender_id, id, title, province, closing_at, status,
        last_value(province IGNORE NULLS) OVER w AS p, last_value(closing_at IGNORE NULLS) OVER w AS c FROM tenders WINDOW w AS (PARTITION BY buyer_org_id ORDER BY id ROWS UNBOUNDED PRECEDING)),
      d AS (SELECT *, lag(id) OVER w IS NULL AS first, (title <> lag(title) OVER w OR status <> lag(status) OVER w OR p IS DISTINCT FROM lag(p) OVER w OR c IS DISTINCT FROM lag(c) OVER w) AS changed,
        row_number() OVER (PARTITION BY tender_id ORDER BY id DESC) AS k FROM s WINDOW w AS (PARTITION BY tender_id ORDER BY id))
      SELECT tender_id, CAST(1 + (SELECT count(*) FROM d e WHERE e.tender_id = d.tender_id AND NOT e.first AND e.changed) AS INT) AS version_no, title, p AS province, c AS closing_at, status FROM d WHERE k = 1""",
    "upsert_versions": f"""{_WITH}, s AS (SELECT buyer_org_id, id, title, status, last_value(closing_at IGNORE NULLS) OVER w AS c FROM tenders WINDOW w AS (PARTITION BY buyer_org_id ORDER BY id ROWS UNBOUNDED PRECEDING)),
      d AS (SELECT *, lag(id) OVER w IS NULL AS first, lag(c) OVER w AS oc, title <> lag(title) OVER w AS dt, status <> lag(status) OVER w AS ds FROM s WINDOW w AS (PARTITION BY buyer_org_id ORDER BY id)),
      v AS (SELECT *, CASE WHEN first THEN 'CREATED' WHEN ds AND status = 'CANCELLED' THEN 'CANCELLED' WHEN oc IS NOT NULL AND c > oc THEN 'EXTENDED' WHEN oc IS NOT NULL AND c < oc THEN 'SHORTENED'
        WHEN dt OR ds OR c IS DISTINCT FROM oc THEN 'DETAILS_CHANGED' END AS kind FROM d),
      n AS (SELECT kind, row_number() OVER (PARTITION BY buyer_org_id ORDER BY id) AS version_no FROM v WHERE kind IS NOT NULL)
      SELECT kind, count(*) AS n, CAST(max(version_no) AS INT) AS top FROM n GROUP BY 1""",
    "upsert_identity": f"""{_WITH},
      a AS (SELECT id, CASE WHEN id % 3 <> 0 THEN 'k' || buyer_org_id END AS nk, 'f' || buyer_org_id || '-' || (id % 8 % 5) AS fp, title, status, authority_score, 'u' || (id % 4) AS url FROM tenders),
      stored AS (SELECT DISTINCT 's' || buyer_org_id AS sid, 'f' || buyer_org_id || '-0' AS fp FROM tenders WHERE id % 7 = 0),
      prints AS (SELECT fp, min(nk) AS nk FROM a WHERE nk IS NOT NULL GROUP BY 1),
      rooted AS (SELECT a.*, CASE WHEN a.nk IS NOT NULL THEN 'n:' || a.nk WHEN p.nk IS NOT NULL THEN 'n:' || p.nk ELSE 'f:' || a.fp END AS root, s.sid FROM a LEFT JOIN prints p ON p.fp = a.fp LEFT JOIN stored s ON s.fp = a.fp),
      named AS (SELECT *, coalesce(sid, min(sid) OVER (PARTITION BY root), sha256(root || '|' || min(id) OVER (PARTITION BY root))) AS tid FROM rooted),
      chain AS (SELECT sid AS tid, -1 AS id, NULL AS nk, fp, 'stored' AS title, 'OPEN' AS status, 50 AS authority_score, ['u9', 'u1'] AS urls FROM stored UNION ALL SELECT tid, id, nk, fp, title, status, authority_score, [url] FROM named),
      d AS (SELECT *, row_number() OVER w AS k, lag(title) OVER w AS ot, lag(status) OVER w AS os FROM chain WINDOW w AS (PARTITION BY tid ORDER BY id)),
      first_url AS (SELECT tid, url, min(k) AS k FROM (SELECT tid, k, unnest(urls) AS url FROM d) GROUP BY 1, 2),
      e AS (SELECT d.*, k = 1 AND id >= 0 AS made, id >= 0 AND k > 1 AND (title <> ot OR status <> os) AS changed, EXISTS (SELECT 1 FROM first_url u WHERE u.tid = d.tid AND u.k = d.k) AS brings FROM d),
      lists AS (SELECT tid, string_agg(url, ',' ORDER BY k, url DESC) AS urls FROM first_url GROUP BY 1)
      SELECT e.tid AS tender_id, arg_min(nk, k) FILTER (nk IS NOT NULL) AS natural_key, arg_max(fp, k) FILTER (id < 0 OR made OR changed OR brings) AS fingerprint,
        CAST(max(CASE WHEN id < 0 THEN 1 ELSE 0 END) + count(*) FILTER (made OR changed) AS INT) AS version_no, arg_max(title, k) AS title, arg_max(status, k) AS status,
        max(authority_score) FILTER (id < 0 OR made OR changed OR brings) AS authority_score, any_value(lists.urls) AS urls
      FROM e JOIN lists USING (tid) GROUP BY e.tid""",
    "archived_once": "SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey AS ocid, o_orderpriority AS release_id, o_orderkey AS id FROM orders ORDER BY o_custkey, o_orderpriority, o_orderkey % 3, o_orderkey",
    "stored_state": f"""{_WITH}, d AS (SELECT *, published_at >= DATE '{STORED_UNTIL}' AS late, lag(title) OVER w AS ot, lag(status) OVER w AS os, row_number() OVER w AS k, row_number() OVER (PARTITION BY buyer_org_id ORDER BY published_at DESC, id DESC) AS back,
        first_value(published_at) OVER w AS begun FROM tenders WINDOW w AS (PARTITION BY buyer_org_id ORDER BY published_at, id)),
      e AS (SELECT *, k = 1 OR title <> ot OR status <> os AS takes FROM d),
      f AS (SELECT buyer_org_id, max(authority_score) FILTER (takes) AS score, max(authority_score) FILTER (takes AND NOT late) AS early_score, count(*) FILTER (takes) AS n, count(*) FILTER (takes AND late) AS n_late, arg_max(title, k) AS title, arg_max(status, k) AS status,
        arg_max(title, k) FILTER (NOT late) AS early_title, arg_max(status, k) FILTER (NOT late) AS early_status, count(*) FILTER (NOT late) AS n_early FROM e GROUP BY 1)
      SELECT 'k' || buyer_org_id AS natural_key, CAST(n AS INT) AS version_no, title, status, score AS authority_score, CASE WHEN n_early = 0 OR n_late > 0 THEN '2026-01-02' ELSE '2026-01-01' END AS updated_on FROM f""",
    "resolve_buyers": "SELECT s_suppkey, 'The ' || (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM unnest(string_split(n_name, ' ')) AS u(w)) AS buyer_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS known_org, n_nationkey % 2 <> 0 AS made FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "wall_time_sast": "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, event_id % 4 IN (0, 3) AS corrected FROM events",
    "date_only_rule": """WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 3 * 11 AS INT)) AS closing FROM orders), d AS (SELECT *, hour(closing) IN (0, 22) AND minute(closing) = 0 AND second(closing) = 0 AS date_only FROM o)
      SELECT o_orderkey, date_only, strftime(CASE WHEN date_only THEN date_trunc('day', closing + INTERVAL 2 HOUR) + INTERVAL 9 HOUR ELSE closing END, '%Y-%m-%d %H:%M:%S') AS closing FROM d""",
    "month_windows": """SELECT greatest(m, DATE '2023-11-15')::DATE AS from_day, least(last_day(m), DATE '2025-02-10')::DATE AS to_day FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2025-02-10', INTERVAL 1 MONTH))::DATE AS m)""",
    "buyer_windows": """WITH b AS (SELECT o_custkey AS buyer_org_id, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1),
      m AS (SELECT *, unnest(generate_series(date_trunc('month', s), e::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM b) SELECT buyer_org_id, greatest(m, s)::DATE AS from_day, least(last_day(m), e)::DATE AS to_day FROM m""",
    "closing_status": f"""{_WITH} SELECT id, CASE WHEN id % 17 = 0 THEN 'CANCELLED' WHEN id % 19 = 0 THEN 'AWARDED' WHEN closing_at IS NULL OR closing_confidence < 0.8::DOUBLE THEN 'UNKNOWN' WHEN closing_at <= TIMESTAMP '{TENDER_AS_OF}' THEN 'CLOSED'
      WHEN closing_at <= TIMESTAMP '{TENDER_AS_OF}' + INTERVAL 72 HOUR THEN 'CLOSING_SOON' ELSE 'OPEN' END AS status_now FROM tenders""",
    "shape_rows": f"""{_WITH} SELECT id, buyer_name, closing_confidence >= 0.8::DOUBLE AS verified, CASE WHEN id % 2 <> 0 THEN 'assumed' END AS note, CASE WHEN closing_confidence < 0.8::DOUBLE THEN 'u/' || id END AS verify_at_source FROM tenders""",
    "low_confidence_routing": f"{_WITH} SELECT id, 'closing_at' AS field, round(closing_confidence, 6) AS confidence FROM tenders WHERE closing_confidence < 0.8::DOUBLE",
    "date_quarantine": f"{_WITH} SELECT id, published_at, closing_at - INTERVAL 10 DAY AS closing_at FROM tenders WHERE closing_at - INTERVAL 10 DAY < published_at",
    "stats_by_group": f"{_WITH} SELECT 'status' AS facet, status AS value, count(*) AS n FROM tenders GROUP BY 2 UNION ALL SELECT 'province', coalesce(province, 'Unspecified'), count(*) FROM tenders GROUP BY 2",
    "open_tenders": f"{_WITH} SELECT count(*) FILTER (status IN ('OPEN', 'CLOSING_SOON', 'EXTENDED', 'RE_ADVERTISED', 'NEW')) AS open FROM tenders",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("orders", "customer", "events", "documents")),
    "lateral_latest": "SELECT DISTINCT ON (o_custkey) o_custkey AS ocid, o_orderkey AS release_id, o_orderdate AS archived_at, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "version_numbers": """WITH o AS (SELECT o_custkey AS tender_id, o_orderkey FROM orders), old AS (SELECT tender_id, count(*) AS top FROM o WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT n.tender_id, o_orderkey, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY n.tender_id ORDER BY o_orderkey) AS INT) AS version_no FROM o n LEFT JOIN old USING (tender_id) WHERE o_orderkey % 3 <> 0""",
}
ORACLE_SQL["clusters_over_time"] = f"SELECT id AS node, cluster FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM ({ORACLE_SQL['duplicate_clusters']})) WHERE n > 1"
