from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procurelake.schemas import release
from procurelake.sources import feeds, ocds, registry

RELEASES = [
    {
        "ocid": "o-1", "id": "r-1", "date": "2026-08-14T08:00:00Z", "tag": ["planning", "tender"], "buyer": {"name": ""},
        "tender": {"id": "77", "title": "SCM 045/2026", "description": "CCTV for the harbour", "province": "KwaZulu-Natal", "mainProcurementCategory": "goods", "category": "goods", "value": {"amount": 0, "currency": "ZAR"},
                   "tenderPeriod": {"endDate": "2026-09-16T11:00:00Z"}, "procuringEntity": {"name": "eThekwini"}, "briefingSession": {"isSession": False, "date": "2026-08-20T10:00:00Z", "compulsory": True},
                   "documents": [{"id": "d1", "title": "Bid", "url": "https://x/bid.pdf"}, {"id": "d2", "title": "no url"}]},
    },
    {"ocid": "o-2", "tender": {"tenderPeriod": {"endDate": "0001-01-01T00:00:00Z"}}},
]


def test_release_files_and_mapping(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"uri": "https://portal/p1", "releases": RELEASES}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps(RELEASES[:1], indent=1))
    rows = ocds.read_releases(spark, str(tmp_path))
    assert sorted(r.source_url.split("/")[-1] for r in rows.collect()) == ["list.json", "p1", "p1"]
    notices = {r.title: r for r in ocds.release_to_notice(rows, "portal", map_value=True).where("source_url = 'https://portal/p1'").collect()}
    full = notices["CCTV for the harbour"]
    assert (full.tender_number, full.buyer_name, full.closing_at) == ("SCM 045/2026", "eThekwini", datetime(2026, 9, 16, 9))
    assert full.briefing_at is None and full.compulsory_briefing is None and full.value_estimated is None
    assert set(full.derived_fields) == {"closing_at", "published_at"} and full.categories == ["goods"]
    assert [(d.url, d.filename) for d in full.documents] == [("https://x/bid.pdf", "Bid")]
    bare = notices["o-2"]
    assert bare.closing_at is None and bare.documents == [] and bare.derived_fields == {}
    archive = ocds.archive_rows(rows.where("source_url like '%p1'")).orderBy("ocid").collect()
    assert [(a.ocid, a.release_id, a.stage) for a in archive] == [("o-1", "r-1", "planning,tender"), ("o-2", None, None)]


def test_empty_release_table(spark):
    empty = spark.createDataFrame([], release()).withColumn("source_url", F.lit("x"))
    assert ocds.release_to_notice(empty, "s").count() == 0


def test_month_windows(spark):
    got = [(str(r.from_day), str(r.to_day)) for r in ocds.month_windows(spark, "2024-01-15", "2024-03-05").orderBy("from_day").collect()]
    assert got == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-05")]
    assert ocds.month_windows(spark, "2024-03-02", "2024-03-01").count() == 0


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>
<item><title>Road &amp; bridge</title><link>https://x/1</link><description><![CDATA[<b>works</b>]]></description><pubDate>Tue, 15 Sep 2026 08:00:00 +0200</pubDate></item>
<item><title>No link</title></item><item><link>https://x/3</link></item>
<item><title>Odd date</title><link>https://x/4</link><pubDate>whenever</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>Pumps</title><link href="https://x/a"/><link href="https://x/b"/><updated>2026-09-15T10:00:00Z</updated></entry></feed>"""
SITEMAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x/Tenders/road-works-2026/</loc></url><url><loc>https://x/about</loc></url></urlset>"""


def test_feeds(spark):
    rows = spark.createDataFrame([("s", "u", RSS), ("t", "u", ATOM), ("v", "u", "no xml"), ("w", "u", None), ("x", "u", RSS[:120])], "source_id string, url string, xml string")
    notices = feeds.parse_feeds(rows)
    assert sorted(r.source_id for r in feeds.for_triage(rows, notices).collect()) == ["v", "w", "x"]
    got = {r.source_url: r for r in notices.collect()}
    assert set(got) == {"https://x/1", "https://x/4", "https://x/a"}
    assert got["https://x/1"].title == "Road & bridge" and got["https://x/1"].published_at == datetime(2026, 9, 15, 6)
    assert got["https://x/4"].published_at is None and got["https://x/a"].published_at == datetime(2026, 9, 15, 10)


def test_feed_dates(spark):
    named = ["Tue, 15 Sep 2026 08:00:00 EST", "15 Sep 26 08:00 PDT", "15 Sep 98 08:00:00 GMT", "15 Sep 2026 8:00:00 -0000", "15 Sep 2026 08:00:00 XYZ"]
    wanted = [datetime(2026, 9, 15, 13), datetime(2026, 9, 15, 15), datetime(1998, 9, 15, 8), datetime(2026, 9, 15, 6), datetime(2026, 9, 15, 6)]
    assert [r.d for r in spark.createDataFrame([(s,) for s in named], "s string").select(feeds.feed_date("s").alias("d")).collect()] == wanted
    said = ["Tue, 15 Sep 2026 08:00:00 GMT", "15 Sep 2026 08:00:00 +0200", "15 Sep 2026 08:00:00", "2026-09-15T08:00:00", "0001-01-01T00:00:00Z", "x", None]
    got = [r.d for r in spark.createDataFrame([(s,) for s in said], "s string").select(feeds.feed_date("s").alias("d")).collect()]
    assert got == [datetime(2026, 9, 15, 8), datetime(2026, 9, 15, 6), datetime(2026, 9, 15, 6), datetime(2026, 9, 15, 6), None, None, None]


def test_sitemaps_and_posts(spark):
    maps = spark.createDataFrame([("s", SITEMAP)], "source_id string, xml string")
    locs = feeds.parse_sitemaps(maps)
    assert [r.loc for r in locs.collect()] == ["https://x/Tenders/road-works-2026/"]
    assert [r.loc for r in feeds.parse_sitemaps(maps, url_filter=None).collect()] == ["https://x/Tenders/road-works-2026/", "https://x/about"]
    assert feeds.parse_sitemaps(spark.createDataFrame([("s", "<urlset><url><loc>broken"), ("t", None)], "source_id string, xml string")).count() == 0
    assert feeds.sitemap_notices(locs).first().title == "road works 2026"
    posts = spark.createDataFrame(
        [(1, "2026-09-15T10:00:00", "2026-09-15T08:00:00", "l1", ("A <b>post</b>",), ("<p>x</p>",)), (2, "2026-09-15T10:00:00", "", "l2", ("",), ("",))],
        "id long, date string, date_gmt string, link string, title struct<rendered:string>, excerpt struct<rendered:string>",
    )
    got = feeds.posts_to_notices(posts, "w").orderBy("source_url").collect()
    assert [(g.title, g.published_at) for g in got] == [("A post", datetime(2026, 9, 15, 8)), ("wp-post-2", datetime(2026, 9, 15, 8))]


def test_first_that_works(spark):
    rows = spark.range(1)
    assert feeds.first_that_works(lambda: None, lambda: spark.range(0), lambda: rows) is rows
    with pytest.raises(LookupError):
        feeds.first_that_works(lambda: spark.range(0))


def test_registry_and_objects(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"ref": "a", "name": "A", "triage_tier": 2}, {"ref": "b", "name": "B", "triage_tier": 1, "frequency_min": 7}]))
    assert {r.ref: r.frequency_min for r in registry.read_registry(spark, str(tmp_path / "r.json")).collect()} == {"a": 90, "b": 7}
    files = tmp_path / "files"
    files.mkdir()
    for name, body in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (files / name).write_bytes(body)
    assert registry.read_objects(spark, str(files)).count() == 2
    known = spark.createDataFrame([("s", "u1", registry.content_hash.__name__, 1)], "source_id string, url string, digest string, seen_at int")
    fresh = spark.createDataFrame([("s", "u1", bytearray(b"x"))], "source_id string, url string, content binary")
    assert registry.changed_bulletins(fresh, known).count() == 1
    seen = fresh.select("source_id", "url", registry.content_hash(F.col("content")).alias("digest"), F.lit(2).alias("seen_at"))
    assert registry.changed_bulletins(fresh, known.unionByName(seen)).count() == 0


def test_adapters_are_registered_once():
    registry.adapter("only-here")(lambda: None)
    with pytest.raises(ValueError):
        registry.adapter("only-here")(lambda: None)
    registry.ADAPTERS.pop("only-here")


def test_adapters_fail_on_their_own(spark):
    registry.adapter("works")(lambda spark, source_id, n=1: spark.range(n).select(F.lit(source_id).alias("source_id"), F.col("id").alias("title")))
    registry.adapter("breaks")(lambda spark, source_id: spark.range(1).select(F.lit(source_id).alias("source_id"), F.raise_error(F.lit("gone")).cast("long").alias("title")))
    try:
        rows, errors = registry.run_adapters(spark, [("a", "works", {"n": 2}), ("b", "breaks", {}), ("c", "unheard of", {}), ("d", "works", {})])
        assert sorted(r.source_id for r in rows.collect()) == ["a", "a", "d"] and [e[0] for e in errors] == ["b", "c"] and "gone" in errors[0][1]
        assert registry.run_adapters(spark, []) == (None, [])
    finally:
        registry.ADAPTERS.pop("works")
        registry.ADAPTERS.pop("breaks")


def test_seed(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"ref": "a", "name": "A", "triage_tier": 2, "note": ""}, {"ref": "a2", "name": "A"}, {"ref": "b", "name": "B"}, {"ref": "c"}]))
    stored = spark.createDataFrame([("B",)], "name string")
    orgs, sources = registry.seed_registry(registry.read_registry(spark, str(tmp_path / "r.json")), stored, stored.limit(0))
    assert [r.name for r in orgs.collect()] == ["A"] and sorted(r.name for r in sources.collect()) == ["A", "B"]
    assert {(r.platform, r.crawl_method, r.status, r.authority_score, r.note) for r in sources.collect()} == {("UNKNOWN", "NONE", "DISCOVERY", 50, None)}
