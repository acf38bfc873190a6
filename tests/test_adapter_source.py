"""The adapters as data sources, batch and streaming."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procurelake.sources import adapter_source as A
from procurelake.streaming import twins

FEED = "<rss><channel>" + "".join(f"<item><title>T{i}</title><link>https://f/{i}</link><pubDate>Tue, 15 Sep 2026 08:00:00 +0200</pubDate></item>" for i in range(3)) + "</channel></rss>"


def halting(options, window):
    for i in range(int(options["n"])):
        yield "note", f"u{i}", str(i)
    raise TimeoutError("the line went dead")


@pytest.fixture
def registry(tmp_path):
    for month, n in (("2026-01", 2), ("2026-02", 1)):
        (tmp_path / f"r-{month}.json").write_text(json.dumps({"uri": f"p/{month}", "releases": [{"ocid": f"{month}-{i}", "tender": {"title": f"SCM {i}", "description": f"Works {month} {i}"}} for i in range(n)]}))
    (tmp_path / "feed.xml").write_text(FEED)
    (tmp_path / "broken.xml").write_text(FEED[: FEED.index("T2")])
    (tmp_path / "map.xml").write_text("<urlset><url><loc> https://x/tender-9/ </loc></url><url><loc>https://x/about</loc></url></urlset>")
    (tmp_path / "posts.json").write_text(json.dumps([{"id": 4, "link": "https://c/4", "date": "2026-09-15T10:00:00", "title": {"rendered": "A <b>post</b>"}, "excerpt": {"rendered": ""}}]))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.pdf").write_bytes(b"%PDF")
    of = lambda i, adapter, **options: {"source_id": i, "adapter": adapter, "options": options}
    return [
        of("portal", "ocds_api", path=f"{tmp_path}/r-{{month}}.json", date_from="2026-01-10", date_to="2026-03-02"), of("feed", "generic_sitemap_rss", path=f"{tmp_path}/feed.xml"), of("broken", "generic_sitemap_rss", path=f"{tmp_path}/broken.xml"),
        of("map", "generic_sitemap_rss", path=f"file://{tmp_path}/map.xml"), of("cms", "generic_cms", path=f"{tmp_path}/posts.json"), of("pdf", "pdf_bulletin", path=f"{tmp_path}/b"), of("odd", "unheard of"), of("dead", "halting", n=2), of("nowhere", "generic_cms", path=f"{tmp_path}/none"),
    ]


def test_all_sources_in_parallel_with_their_errors(spark, registry):
    records = A.read_sources(spark, registry, {"halting": A.Reader(halting)})
    assert records.rdd.getNumPartitions() == len(registry) + 2  # three months of the portal
    notices = A.to_notices(records).collect()
    assert sorted((n.source_id, n.title) for n in notices) == [
        ("broken", "T0"), ("broken", "T1"), ("cms", "A post"), ("feed", "T0"), ("feed", "T1"), ("feed", "T2"), ("map", "tender 9"), ("pdf", "one.pdf"),
        ("portal", "Works 2026-01 0"), ("portal", "Works 2026-01 1"), ("portal", "Works 2026-02 0"),
    ]
    assert {n.published_at for n in notices if n.source_id == "feed"} == {datetime(2026, 9, 15, 6)}
    errors = {(r.source_id, str(r.window_from)): (r.yielded, r.error.split(":")[0]) for r in A.source_errors(records).collect()}
    assert errors == {("broken", "None"): (2, "ValueError"), ("portal", "2026-03-01"): (0, "FileNotFoundError"), ("odd", "None"): (0, "KeyError"), ("dead", "None"): (2, "TimeoutError"), ("nowhere", "None"): (0, "FileNotFoundError")}
    # what a source gave before it failed is kept
    assert records.where("source_id = 'dead' and kind = 'note'").count() == 2


def test_filters_decide_which_partitions_exist(spark, registry):
    records = A.read_sources(spark, registry, {"halting": A.Reader(halting)})
    for condition, n in (("source_id = 'portal'", 3), ("source_id = 'portal' and window_from >= date'2026-02-01'", 2), ("adapter in ('generic_cms', 'pdf_bulletin')", 3), ("window_from < date'2026-02-01' and kind = 'release'", 1), ("source_id = 'none'", 0)):
        found = records.where(condition)
        assert found.rdd.getNumPartitions() <= max(1, n) and found.select("source_id", "window_from").distinct().count() == n, condition
    assert records.where("source_id <=> 'feed' and position > 0").count() == 2
    assert A.read_sources(spark, []).count() == 0
    with pytest.raises(ValueError):
        A.notice_source({"ocds_api": A.Reader(halting)})


START = "2026-01-01T00:00:00"
SOURCES = [{"source_id": f"s{i}", "adapter": "notes", "frequency_min": m, "options": {"n": i}} for i, m in enumerate((7, 30, 60, None, 0))]


def want(until_min):
    base = datetime(2026, 1, 1)
    out = []
    for s in SOURCES:
        step = s["frequency_min"] or A.DEFAULT_MINUTES
        epoch = datetime(1970, 1, 1)
        minute = int((base - epoch).total_seconds()) // 60
        out += [(s["source_id"], epoch + timedelta(minutes=t)) for t in range(minute + 1, minute + until_min + 1) if t % step == 0]
    return sorted(out)


def test_ticks_survive_kill_and_restart(spark, tmp_path):
    """A batch that dies is run again with the same ticks, and later starts go on after the last one: each tick once."""
    state = {"fail": True}
    store = twins.append_new(["source_id", "due_at"], f"{tmp_path}/out")

    def sink(batch, n):
        store(batch, n)
        if state["fail"]:
            state["fail"] = False
            raise RuntimeError("killed after the write and before the commit")

    seen = []
    for until in ("2026-01-01T02:00:00", "2026-01-01T02:00:00", "2026-01-01T02:00:00", "2026-01-01T05:30:00", "2026-01-02T00:00:00"):
        query = A.due_stream(spark, SOURCES, START, until).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        except Exception as e:  # the first start is killed
            assert "killed" in str(e)
        query.stop()
        seen.append(spark.read.parquet(f"{tmp_path}/out").count())
    rows = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source_id", "due_at").collect()))
    assert rows == want(24 * 60) and seen[0] == seen[1] == seen[2] < seen[3] < seen[4]
    known = spark.createDataFrame([(s["source_id"], s["frequency_min"]) for s in SOURCES], "source_id string, frequency_min int")
    twin = A.due_between(known, F.lit(START).cast("timestamp"), F.lit("2026-01-02").cast("timestamp"))
    assert sorted(map(tuple, twin.collect())) == rows


def test_crawl_reads_what_is_due(spark, tmp_path):
    notes = lambda options, window: iter([("note", None, "x")] * int(options["n"]))
    got = []
    sink = lambda records, n: got.extend(r.source_id for r in records.where("kind = 'note'").collect())
    for until in ("2026-01-01T00:07:00", "2026-01-01T00:31:00"):
        query = A.crawl(spark, SOURCES, sink, f"{tmp_path}/ck", START, until, {"notes": A.Reader(notes)}, {"processingTime": "0 seconds"})
        query.processAllAvailable()
        query.stop()
    assert got and got.count("s1") == 1 and "s2" not in got
