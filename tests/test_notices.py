"""Notices end to end: normalising, ingest, repairs, merging, extraction against plain versions."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from procurelake.operators import extract as E
from procurelake.operators.dedupe import clusters, duplicate_links, merge_by_authority
from procurelake.operators.normalize import normalize_notices, shape_tenders
from procurelake.operators.versions import TRACKED, upsert
from procurelake.plans import schedule
from procurelake.plans.ingest import ingest_window
from procurelake.schemas import PROVENANCE, notice, release
from procurelake.sources.feeds import as_notices
from procurelake.sources.ocds import release_to_notice

EXISTING = "tender_id string, natural_key string, fingerprint string, version_no int, title string, tender_number string, description string, buyer_name string, province string, published_at timestamp, closing_at timestamp, briefing_at timestamp, compulsory_briefing boolean, value_estimated decimal(18,2), currency string"


def test_normalize(spark):
    rows = [
        Row(source_id="s", source_url="u1", title="  Road works ", tender_number="SCM 045/2026", buyer_name="City of Durban", closing_at=datetime(2026, 9, 15, 22), derived_fields={"closing_at": "zone kept"}),
        Row(source_id="s", source_url="u2", title="Pumps", tender_number=None, buyer_name=None, closing_at=datetime(2026, 9, 16, 9, 30), derived_fields={"closing_at": "zone kept"}),
        Row(source_id="s", source_url="u3", title=None, tender_number="", buyer_name="", closing_at=None, derived_fields=None),
    ]
    df = as_notices(spark.createDataFrame(rows, "source_id string, source_url string, title string, tender_number string, buyer_name string, closing_at timestamp, derived_fields map<string,string>"))
    got = {r.source_url: r for r in normalize_notices(df, 70).collect()}
    full, timed, bare = got["u1"], got["u2"], got["u3"]
    # midnight local time is a date without a time: eleven o'clock of that day, inferred and for review
    assert full.title == "Road works" and full.closing_at == datetime(2026, 9, 16, 9) and full.authority_score == 70
    assert full.field_provenance["closing_at"].source == "INFERRED" and full.field_provenance["closing_at"].confidence == 0.75
    assert [i.field for i in full.review_items] == ["closing_at"] and full.field_provenance["title"].source == "SOURCE"
    assert timed.closing_at == datetime(2026, 9, 16, 9, 30) and timed.field_provenance["closing_at"].source == "DERIVED"
    assert timed.field_provenance["closing_at"].note == "zone kept" and timed.review_items == []
    assert bare.field_provenance == {} and bare.review_items == [] and full.natural_key and full.source_urls == ["u1"]
    assert {r.confidence for r in normalize_notices(df, structured=False).where("source_url = 'u1'").select("field_provenance.title.confidence").collect()} == {0.7}
    assert normalize_notices(df.limit(0)).count() == 0 and set(notice().names) <= set(df.columns)


def release_rows(spark, items):
    lines = spark.createDataFrame([(json.dumps(i),) for i in items], "j string")
    return lines.select(F.from_json("j", release()).alias("r"), F.lit("u").alias("source_url")).select("r.*", "source_url")


def item(n, title="Paving", end="2026-09-16T11:00:00Z", **more):
    return {"ocid": f"o-{n}", "id": f"r-{n}", "date": f"2026-08-{n + 1:02}T08:00:00Z", "buyer": {"name": "City of X"}, "tender": {"id": str(n), "title": f"T {n}/2026", "description": title, "tenderPeriod": {"endDate": end}} | more}


def test_ingest_window(spark):
    empty = spark.createDataFrame([], EXISTING)
    archive = spark.createDataFrame([], "ocid string, release_id string")
    first = ingest_window(release_rows(spark, [item(1), item(2)]), empty, archive, "portal")
    counts = lambda i: {r.counter: r.n for r in i.counters.collect()}
    assert counts(first) == {"releases": 2, "archived": 2, "created": 2, "updated": 0, "unchanged": 0}
    # what is not tracked is in the state too
    for r in first.tenders.collect():
        assert r.source_urls and r.authority_score == 50 and "title" in r.field_provenance and r.review_items is not None and r.documents is not None
    kept = first.archived.select("ocid", "release_id")
    again = ingest_window(release_rows(spark, [item(1), item(2)]), first.tenders, kept, "portal")
    assert counts(again) == {"releases": 2, "archived": 0, "created": 0, "updated": 0, "unchanged": 2}
    later = ingest_window(release_rows(spark, [item(1, end="2026-09-20T11:00:00Z"), item(3)]), first.tenders, kept, "portal")
    assert counts(later) == {"releases": 2, "archived": 1, "created": 1, "updated": 1, "unchanged": 0}
    assert {(r.kind, r.version_no) for r in later.versions.collect()} == {("CREATED", 1), ("EXTENDED", 2)}
    assert later.tenders.count() == 3


def test_upsert_folds_arrivals(spark):
    existing = spark.createDataFrame([("t1", "k1", "f1", 1, "Old", "OPEN", datetime(2026, 1, 5))], "tender_id string, natural_key string, fingerprint string, version_no int, title string, status string, closing_at timestamp")
    rows = [("k1", "f1", "Old", "RE_ADVERTISED", None, 1), (None, "f1", "Old", "CANCELLED", None, 2), (None, "f2", "New", "OPEN", None, 1), ("k1", "f1", None, None, datetime(2026, 1, 2), 3)]
    incoming = spark.createDataFrame(rows, "natural_key string, fingerprint string, title string, status string, closing_at timestamp, seen_at int")
    state, versions = upsert(existing, incoming)
    got = sorted((r.tender_id if r.tender_id == "t1" else "new", r.version_no, r.kind) for r in versions.collect())
    # the third arrival has no natural key and is found by its fingerprint
    assert got == [("new", 1, "CREATED"), ("t1", 2, "RE_ADVERTISED"), ("t1", 3, "CANCELLED"), ("t1", 4, "SHORTENED")]
    last = {r.tender_id: r for r in state.collect()}["t1"]
    assert (last.title, last.status, last.closing_at, last.version_no) == ("Old", "CANCELLED", datetime(2026, 1, 2), 4) and "title" in TRACKED


STORED = "tender_id string, natural_key string, fingerprint string, version_no int, title string, closing_at timestamp, source_urls array<string>, documents array<struct<url:string,filename:string>>, review_items array<struct<field:string,confidence:double>>, authority_score int, field_provenance map<string,string>, buyer_org_id string"
ARRIVING = STORED.replace("tender_id string, ", "").replace("version_no int, ", "") + ", seen_at int"


def test_arrivals_of_one_batch_are_identified(spark):
    """One with and one without a natural key but the same fingerprint are one tender, whichever comes first; so are those that others connect."""
    row = lambda nk, fp, at: (nk, fp, "T", None, [f"u{at}"], [], [], 10, {}, None, at)
    none = spark.createDataFrame([], STORED)
    for rows, n in (
        ([row("k1", "f1", 1), row(None, "f1", 2)], 1), ([row(None, "f1", 1), row("k1", "f1", 2), row("k1", "f2", 3), row(None, "f2", 4)], 1),
        ([row("k1", "f1", 1), row("k2", "f1", 2), row(None, "f3", 3), row("k2", "f3", 4), row(None, "f9", 5)], 2), ([row(None, None, 1), row(None, None, 2)], 2), ([], 0),
    ):
        incoming = spark.createDataFrame(rows, ARRIVING)
        state, versions = upsert(none, incoming)
        assert state.count() == n == versions.where("kind = 'CREATED'").count()
        if len(rows) != 4:
            continue
        again, more = upsert(state, incoming)
        assert sorted(map(tuple, again.select("tender_id", "version_no").collect())) == sorted(map(tuple, state.select("tender_id", "version_no").collect())) and more.count() == 0
    # an arrival that only others connect with a stored tender is that tender; one that a stored tender matches stays with it
    stored = spark.createDataFrame([("s1", "k1", "f0", 3, "T", None, ["u0"], [], [], 10, {}, None), ("s2", "k5", "f5", 1, "T", None, ["u5"], [], [], 10, {}, None)], STORED)
    state, _ = upsert(stored, spark.createDataFrame([row(None, "f1", 1), row("k1", "f1", 2), row("k5", "f1", 3)], ARRIVING))
    assert {r.tender_id: set(r.source_urls) for r in state.collect()} == {"s1": {"u0", "u1", "u2"}, "s2": {"u5", "u3"}}


def test_upsert_keeps_what_is_not_tracked(spark):
    at = lambda d: datetime(2026, 1, d)
    stored = spark.createDataFrame([("t", "k", "f0", 4, "Old", at(9), ["a", "b"], [("d1", "x")], [("closing_at", 0.5)], 60, {"title": "old"}, "o1")], STORED)
    rows = [
        ("k", "f1", "Old", at(9), ["c", "a"], [("d1", "other"), ("d2", "y")], [("closing_at", 0.1), ("value", 0.2)], 40, {"title": "new url"}, None, 1),
        ("k", "f2", "New", at(12), ["a"], None, None, 90, {"title": "changed"}, "o2", 2),
        ("k", "f3", "New", None, ["b"], [("d3", "z")], [("requirements", 0.3)], 99, {"title": "nothing new"}, "o3", 3),
    ]
    state, versions = upsert(stored, spark.createDataFrame(rows, ARRIVING))
    r = state.first()
    assert (r.tender_id, r.version_no, r.title, r.closing_at, r.fingerprint) == ("t", 5, "New", at(12), "f2")
    assert r.source_urls == ["a", "b", "c"] and [(d.url, d.filename) for d in r.documents] == [("d1", "x"), ("d2", "y")]
    assert [(i.field, i.confidence) for i in r.review_items] == [("closing_at", 0.5), ("value", 0.2)]
    assert (r.authority_score, r.field_provenance, r.buyer_org_id) == (90, {"title": "changed"}, "o2")
    assert [(v.kind, v.version_no) for v in versions.collect()] == [("EXTENDED", 5)]


def test_timezone_repairs(spark):
    raw = json.dumps(item(1))
    archive = spark.createDataFrame([("o-1", "r-0", "{}", 1), ("o-1", "r-1", raw, 2), ("o-2", "r-2", None, 1)], "ocid string, release_id string, raw string, archived_at int")
    tender = [("a", "o-1", datetime(2026, 9, 16, 11), None, datetime(2026, 8, 2, 6), {"title": ("SOURCE", "s", 1.0, None)}), ("b", "o-2", None, None, None, None), ("c", None, None, None, None, None)]
    tenders = spark.createDataFrame(tender, f"tender_id string, ocid string, closing_at timestamp, briefing_at timestamp, published_at timestamp, field_provenance map<string,{PROVENANCE}>")
    versions = spark.createDataFrame([("a", 4)], "tender_id string, version_no int")
    repaired, rows = schedule.timezone_repairs(tenders, archive, versions, "portal")
    got = repaired.collect()
    # the closing date claimed UTC and is local; the publishing time was right already
    assert [(r.tender_id, r.closing_at, r.published_at) for r in got] == [("a", datetime(2026, 9, 16, 9), datetime(2026, 8, 2, 6))]
    assert got[0].field_provenance["closing_at"].source == "DERIVED" and got[0].field_provenance["title"].source == "SOURCE"
    assert [(r.tender_id, r.version_no, r.kind, [c.field for c in r.changes]) for r in rows.collect()] == [("a", 5, "TIMEZONE_CORRECTION", ["closing_at"])]
    assert schedule.timezone_repairs(repaired, archive, versions, "portal")[0].count() == 0
    assert release_to_notice(release_rows(spark, [item(1)]), "p").first().closing_at == datetime(2026, 9, 16, 9)


def test_merge(spark):
    prov = lambda s: ("SOURCE", s, 0.9, None)
    rows = [
        (1, 7, 90, "hi", "Title A", None, ["u1"], [("d1", "x")], {"title": prov("hi")}, [("closing_at", 0.5)]),
        (2, 7, 50, "lo", "Title B", "Gauteng", ["u2", "u1"], [("d1", "other"), ("d2", "y")], {"title": prov("lo"), "province": prov("lo"), "extra": prov("lo")}, [("closing_at", 0.4)]),
        (3, 7, 50, "mid", "", "Limpopo", None, None, {"province": prov("mid")}, None),
        (4, 8, 10, "x", None, None, [], [], None, []),
    ]
    df = spark.createDataFrame(rows, f"id long, cluster long, authority_score int, source_id string, title string, province string, source_urls array<string>, documents array<struct<url:string,filename:string>>, field_provenance map<string,{PROVENANCE}>, review_items array<struct<field:string,confidence:double>>")
    got = {r.cluster: r for r in merge_by_authority(df.repartition(3)).collect()}
    r = got[7]
    assert (r.id, r.members, r.title, r.province, r.source_id, r.authority_score) == (1, 3, "Title A", "Gauteng", "hi", 90)
    assert [(c.field, c.winner_source, c.winner_value, c.loser_source, c.loser_value) for c in r.conflicts] == [("title", "hi", "Title A", "lo", "Title B"), ("province", "lo", "Gauteng", "mid", "Limpopo")]
    assert r.source_urls == ["u1", "u2"] and [(d.url, d.filename) for d in r.documents] == [("d1", "x"), ("d2", "y")]
    assert {k: v.source_id for k, v in r.field_provenance.items()} == {"title": "hi", "province": "lo", "extra": "lo"}
    assert [i.confidence for i in r.review_items] == [0.5, 0.4]
    assert (got[8].members, got[8].conflicts, got[8].source_urls, got[8].review_items) == (1, [], [], [])


def test_duplicates_against_pairs(spark):
    titles = ["supply of pumps", "supply of pumps and pipes", "pumps supply of", "road works phase one two three four", "road works phase one two three five", "other"]
    rows = [(i, t, None, "buyer", "", datetime(2026, 1, 1).date()) for i, t in enumerate(titles * 3)] + [(100, "x", "same", "b2", "", None), (101, "y", "same", "b3", "", None), (102, "z", None, "b4", "n1", None), (103, "w", None, "b4", "n1", None)]
    df = spark.createDataFrame(rows, "id long, title string, fingerprint string, buyer_key string, normalized_tender_number string, closing_day date")
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            alike = a[5] and b[5] and a[3] == b[3] and len(words(a[1]) & words(b[1])) / len(words(a[1]) | words(b[1])) >= 0.8
            if (a[2] and a[2] == b[2]) or (a[4] and (a[3], a[4]) == (b[3], b[4])) or alike:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    got = {r.id: r.cluster for r in clusters(df, duplicate_links(df, threshold=0.8)).collect()}
    assert got == {i: find(i) for i in root}


# extraction


def python(pattern):
    """A Java pattern's flags as Python writes them."""
    return re.sub(r"^\(\?(\w+)\)", lambda m: f"(?{m[1].lower()})", pattern)


def plain_extract(text):
    """The fields by plain loops over the same patterns."""
    sast = timezone(timedelta(hours=2))
    text, out = text or "", {}

    def when(g, base, hour):
        try:
            if g[base]:
                y, m, d = int(g[base + 2]), E.MONTHS.index(g[base + 1].lower()) + 1, int(g[base])
            elif g[base + 3]:
                y, m, d = (int(x) for x in g[base + 3 : base + 6])
            else:
                d, m, y = (int(x) for x in g[base + 6 : base + 9])
            at = datetime(y, m, d, tzinfo=sast)
        except (ValueError, TypeError):
            return None, False
        try:
            if g[base + 9]:
                return at.replace(hour=int(g[base + 9]) + (12 if (g[base + 11] or "").lower() == "pm" and int(g[base + 9]) < 12 else 0), minute=int(g[base + 10])), True
        except ValueError:
            pass
        return at.replace(hour=hour), False

    for m in re.finditer(python(E.NUMBER), text[:8000]):
        found = m[1].strip().rstrip(".")
        if re.search(r"\d", found) and len(found) <= 30:
            out["tender_number"] = (found, 0.85 if m.start() < 2000 else 0.7, m[0])
            break
    if m := re.search(python(E.CLOSING), text):
        at, timed = when(m.groups(), 0, 11)
        if at:
            out["closing_at"] = (at, 0.75 if timed else 0.6, m[0])
    near = re.search(python(E.COMPULSORY), text)
    if m := re.search(python(E.BRIEFING), text):
        at, _ = when(m.groups(), 1, 0)
        if at:
            out["briefing_at"] = (at, 0.7, m[0])
        out["compulsory_briefing"] = (bool(m[1] or near), 0.8 if m[1] else 0.65, m[0][:120])
    elif near:
        out["compulsory_briefing"] = (True, 0.6, near[0])
    grades = sorted({f"{g}{c}" for g, c in re.findall(python(E.GRADE), text)})
    if grades and re.search(python(E.GRADE_CONTEXT), text):
        out["cidb_grades"] = (grades, 0.8, f"grades {grades}")
    if m := re.search(python(E.LEVEL), text):
        out["bbee_level"] = (f"Level {m[1]}", 0.75, m[0])
    if m := re.search(python(E.EMAIL), text):
        out["contact_email"] = (m[0].lower(), 0.9, m[0])
    if m := re.search(python(E.PHONE), text):
        out["contact_phone"] = (re.sub(r"[\s-]", "", m[0]), 0.8, m[0])
    if m := re.search(python(E.VALUE), text):
        try:
            amount = float(re.sub(r"[\s,]", "", m[1]).rstrip("."))
            if 1_000 <= amount <= 10_000_000_000:
                out["value_estimated"] = (amount, 0.6, m[0][:120])
        except ValueError:
            pass
    return out


TEXTS = [
    None,
    "",
    "   ",
    "INVITATION TO TENDER\nTender: ABCDEFGH\nTender No: ABC/123.\nClosing date: 15 September 2026 at 11:00",
    "Tender: ABCDEFGHIJKLMNOPQRSTUVWXYZABCD 1\n" + "filler " * 500 + "Tender No: ABC/123",
    "x" * 2100 + " Bid No: SCM 12/2026",
    "RFQ: " + "A" * 40 + "1 then Quotation No SCM-7/26",
    "closing date: ١٥ september ٢٠٢٦",
    "closing date: 99 september 2026",
    "Closing: 2026-09-15, 25:00. Due 31/12/2026 at 2h30 pm",
    "closes 31/02/2026",
    "closing time 1/2/0000",
    "submission deadline: 1st of march 2026 at 12:05 pm",
    "A non-compulsory briefing on 4 May 2026. Compulsory forms attached",
    "Compulsory site inspection will be held at the depot on 12/03/2026 at 9h15",
    "A compulsory clarification for all; briefing follows",
    "briefing session to be announced. It is mandatory",
    "CIDB grading 7 GB or 6CE, 6 CE; product 9SQ",
    "product 9SQ only",
    "B-BBEE level 3, b bbee contributor level: level 4",
    "Mail Sales.Team+x@Example.co.za or +27 31 555 0123, 031-555-0199",
    "Estimated value: R 12345.678",
    "budget of about R 1,250,000.00 excl",
    "contract value R 999",
    "Estimated cost R 1.2.3.4",
    "Budget: R ١٢٣٤٥",
]


def test_extraction_against_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for r in E.extract_fields(rows).collect():
        got = {f: tuple(r[f]) for f in E.FIELDS if r[f] is not None}
        for f in ("closing_at", "briefing_at"):
            if f in got:
                got[f] = (got[f][0].replace(tzinfo=timezone.utc), *got[f][1:])
        assert got == {f: (v, c, e[:200]) for f, (v, c, e) in plain_extract(TEXTS[r.doc_id]).items()}, TEXTS[r.doc_id]
    assert E.extract_fields(rows.limit(0)).count() == 0 and E.long_form(E.extract_fields(rows.limit(0))).count() == 0


def test_fields_are_found_in_the_whole_text(spark):
    late = "INVITATION Tender: ABCDEFGH " + "filler " * 2_000
    every = "Tender No: ABC/123, Closing date: 15 September 2026 at 11:00. Compulsory briefing session on 4 May 2026. CIDB 7 GB. B-BBEE level 3. Mail a@b.co.za or 031 555 0123. Budget: R 12345"
    texts = [late + every, "x" * 7_985 + " Tender No: ABC/123456", "Bid No: SCM 1/26, " + late + every, late * 20 + every, "\x01" * 9_000 + " " + every]
    got = {r.doc_id: r for r in E.extract_fields(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    numbers = [tuple(got[i].tender_number) for i in range(len(texts))]
    assert numbers == [("ABC/123", 0.7, "Tender No: ABC/123"), ("ABC/123456", 0.7, "Tender No: ABC/123456"), ("SCM 1/26", 0.85, "Bid No: SCM 1/26"), ("ABC/123", 0.7, "Tender No: ABC/123"), ("ABC/123", 0.7, "Tender No: ABC/123")]
    assert all(got[i][f] is not None for i in (0, 2, 3, 4) for f in E.FIELDS)


def test_process_documents(spark):
    docs = spark.createDataFrame([(1, None, "d1", "Bid No: A 1/26"), (2, None, "d1", "Bid No: A 1/26"), (3, "done", "d2", "Bid No: B 2/26"), (4, None, "d3", None)], "doc_id long, content_hash string, digest string, text string")
    known = spark.createDataFrame([("d3", "Bid No: C 3/26")], "digest string, text string")
    got = {r.doc_id: r.tender_number.value for r in E.process_documents(docs, known).collect()}
    assert got == {1: "A 1/26", 2: "A 1/26", 4: "C 3/26"}


def test_review_cycle(spark):
    at = datetime(2026, 1, 1)
    queue = spark.createDataFrame([(1, "t", "closing_at", "v1", at, None, None), (2, "t", "value", None, at, None, None), (3, "u", "closing_at", "v3", at, at, "approve")], "id long, tender_id string, field string, value string, queued_at timestamp, resolved_at timestamp, resolution string")
    decisions = spark.createDataFrame([(1, "correct", "v1b", at), (2, "approve", None, at), (3, "reject", None, at)], "id long, action string, value string, decided_at timestamp")
    writes, after = E.resolve_reviews(queue, decisions)
    assert [(w.tender_id, w.field, w.value, w.confidence) for w in writes.collect()] == [("t", "closing_at", "v1b", 1.0)]
    assert {r.id: r.resolution for r in after.collect()} == {1: "correct", 2: None, 3: "approve"}
    items = spark.createDataFrame([("t", "closing_at"), ("u", "closing_at"), ("u", "closing_at")], "tender_id string, field string")
    assert [(r.tender_id, r.field) for r in E.enqueue_reviews(queue, items).collect()] == [("u", "closing_at")]


def test_first_decision_and_outcome_count(spark):
    at = lambda d: datetime(2026, 1, d)
    queue = spark.createDataFrame([(1, "t", "closing_at", "v1", at(1), None, None)], "id long, tender_id string, field string, value string, queued_at timestamp, resolved_at timestamp, resolution string")
    decisions = spark.createDataFrame([(1, "correct", "late", at(4)), (1, "correct", None, at(2)), (1, "approve", None, at(3)), (1, "reject", None, at(5)), (1, "odd", "x", at(1))], "id long, action string, value string, decided_at timestamp")
    writes, after = E.resolve_reviews(queue, decisions)
    assert [(w.value, w.kind) for w in writes.collect()] == [("v1", "HUMAN_VERIFIED")]
    assert [(r.resolution, r.resolved_at) for r in after.collect()] == [("approve", at(3))]
    jobs = spark.createDataFrame([(1, 0, "FETCHING", None, None)], "job_id long, attempts int, state string, next_retry_at timestamp, error string")
    outcomes = spark.createDataFrame([(1, True, None, at(2)), (1, False, "late", at(3))], "job_id long, ok boolean, error string, at timestamp")
    assert [(r.state, r.attempts) for r in schedule.after_run(jobs, outcomes).collect()] == [("DONE", 0)]


def test_overview_is_its_parts(spark):
    from procurelake.plans import health as H

    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    sources = spark.createDataFrame([(1, 1, 30, "ACTIVE", "a", at(0), at(5)), (2, 2, 90, "ACTIVE", None, None, at(5))], "source_id long, triage_tier int, frequency_min int, status string, adapter string, last_success timestamp, last_checked timestamp")
    checks = spark.createDataFrame([(1, at(0), True, None, None), (2, at(1), False, "e", None), (2, at(5), False, "f", None)], "source_id long, checked_at timestamp, ok boolean, error string, started_at timestamp")
    jobs = spark.createDataFrame([(7, 1, at(0), "DONE", 0, None, 2, 1, '{"created": 2, "updated": 1}')], "job_id long, source_id long, run_time timestamp, state string, attempts int, next_retry_at timestamp, created int, updated int, extracted_fields string")
    seen = H.overview(sources, checks, jobs, F.lit(at(10)))
    assert [(r.source_id, r.state) for r in seen["verdicts"].collect()] == [(2, "DEGRADED"), (1, "OK")]
    assert seen["summary"].first().healthy == 1 and seen["crawl"].first().tenders_created == 2 and seen["mttr"].first().episodes == 1
    assert [r.error for r in seen["failures"].collect()] == ["f", "e"] and {r.adapter for r in seen["adapters"].collect()} == {"a", "(none)"} and seen["freshness"].count() == 2
    code, lines = H.pager_report(seen["verdicts"])
    assert code == 1 and lines.count() == 0


def test_shape_with_highlights(spark):
    prov = f"field_provenance map<string,{PROVENANCE}>"
    rows = [(1, "a", {"closing_at": ("INFERRED", "s", 0.75, "note")}, "<mark>a</mark>", None), (2, "b", {"closing_at": ("SOURCE", "s", 0.98, None)}, None, None)]
    df = spark.createDataFrame(rows, f"id long, title string, {prov}, title_highlight string, snippet string")
    none = {c: F.lit(None).cast("string") for c in ("tender_number", "province", "status", "buyer_org_id", "buyer_name")}
    df = df.withColumns(none | {"published_at": F.lit(None).cast("timestamp"), "closing_at": F.lit(datetime(2026, 1, 1)), "source_urls": F.array(F.lit("u")), "value_estimated": F.lit(5)})
    got = {r.id: r for r in shape_tenders(df).collect()}
    assert got[1].closing.note == "note" and got[1].closing.verify_at_source == "u" and not got[1].closing.verified and got[1].highlight.title_highlight == "<mark>a</mark>"
    assert got[2].closing.note is None and got[2].closing.verify_at_source is None and got[2].closing.verified and got[2].highlight is None


def test_schedule_parts(spark):
    found = spark.createDataFrame([(1, "WORDPRESS", "generic_cms", "HTML", 0.9), (2, "CUSTOM_HTML", None, "HTML", 0.5)], "source_id long, platform string, adapter string, crawl_method string, confidence double")
    sources = spark.createDataFrame([(1, "DISCOVERY", None, {"k": "v"}), (2, "DISCOVERY", None, None), (3, "DISCOVERY", None, None), (4, "ACTIVE", "x", None)], "source_id long, status string, adapter string, config map<string,string>")
    got = {r.source_id: r for r in schedule.discovery_update(sources, found).collect()}
    assert (got[1].status, got[1].adapter, got[1].config) == ("ACTIVE", "generic_cms", {"k": "v", "probe_confidence": "0.9"}) and got[2].status == "DISCOVERY"
    assert {r.outcome: r.n for r in schedule.discovery_counts(sources, found).collect()} == {"activated": 1, "undecided": 1, "unreachable": 1}
    events = spark.createDataFrame([("users", "1", "user.created", 7, "admin", {"Password": "p", "email": "e"}), ("users", "1", None, 7, None, None), ("users", "2", "user.disabled", None, None, None)], "table_name string, record_id string, action string, user_id long, actor string, detail map<string,string>")
    assert [(r.record_id, json.loads(r.details)) for r in schedule.audit_rows(events).collect()] == [("1", {"email": "e", "actor": "admin"}), ("2", {})]
    users = spark.createDataFrame([("a@x", "Ann"), ("b@x", None)], "email string, name string")
    incoming = spark.createDataFrame([("A@x", "", 2), ("b@x", "Bob", 1), ("b@x", "", 3), ("c@x", None, 1)], "email string, name string, at int")
    assert {r.email: r.name for r in schedule.upsert_users(users, incoming).collect()} == {"a@x": "Ann", "b@x": "Bob", "c@x": None}
    raw = [('{"format": "rss"}', True), ('{"format": "sitemap"}', False), ('{"format": "pdf_bulletin"}', False), (None, True), ("{}", True)]
    assert all(r.s == r.w for r in spark.createDataFrame(raw, "raw string, w boolean").select(schedule.is_structured(F.col("raw")).alias("s"), "w").collect())
    results = spark.createDataFrame([([str(i) for i in range(300)], 2, 1)], "raw array<string>, created int, updated int")
    one = schedule.result_rows(results).first()
    assert len(one.raw) == 200 and json.loads(one.extracted_fields) == {"created": 2, "updated": 1}
    at = datetime(2026, 1, 2)
    sessions = spark.createDataFrame([(1, datetime(2026, 1, 3), None), (1, datetime(2026, 1, 1), None), (1, datetime(2026, 1, 3), at)], "user_id long, expires_at timestamp, revoked_at timestamp")
    assert {r.user_id: r.live for r in schedule.live_sessions(sessions, spark.createDataFrame([(1,), (2,)], "user_id long"), F.lit(at)).collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize("ok", [True, False])
def test_source_states(spark, ok):
    rows = spark.createDataFrame([("ACTIVE", False), ("DEGRADED", False), ("ACTIVE", True), ("BLOCKED", False)], "status string, final boolean")
    got = [r.s for r in rows.select(schedule.source_status_after("status", F.lit(ok), "final").alias("s")).collect()]
    assert got == (["ACTIVE", "ACTIVE", "ACTIVE", "BLOCKED"] if ok else ["DEGRADED", "DEGRADED", "FAILED", "BLOCKED"])


def test_groups_of_a_match_are_found_at_once(spark):
    plan = E.extract_fields(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(E.CLOSING) <= 2 and 0 < plan.count(E.BRIEFING) <= 2 and plan.count(E.NUMBER) == 1


def test_extraction_where_marks_and_other_letters_stand(spark):
    texts = ["\x01 Tender No: ABC/1\x01 and \x02 Bid No: SCM 2/26\x03", "x" * 1990 + "\x01" * 20 + " Bid No: SCM 12/26", "ſubmiſſıon deadlİne: 1 may 2026", "ſite meeting on 1/2/2026 at 0:00", "due 1/2/2026 at 24:10", "due 2026-02-29"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in E.extract_fields(rows).collect()}
    assert (got[0].tender_number.value, got[0].tender_number.evidence, got[1].tender_number.confidence) == ("ABC/1", "Tender No: ABC/1", 0.7)
    day = lambda x: x and x.value.replace(tzinfo=timezone.utc).isoformat()
    assert (day(got[2].closing_at), day(got[3].briefing_at), day(got[4].closing_at), day(got[5].closing_at)) == ("2026-05-01T09:00:00+00:00", "2026-01-31T22:00:00+00:00", "2026-02-01T09:00:00+00:00", None)


def test_patterns_run_only_where_their_words_stand(spark):
    plan = E.extract_fields(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") >= len(E.NEEDED)
    # each letter that a pattern takes for one of a word's
    odd = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]))
    letters = {x: {c for c in odd if re.search(x, c, re.I)} for x in {c for groups in E.NEEDED.values() for g in groups for word in g for c in word if c.isalpha()}}
    assert {c for found in letters.values() for c in found} <= {"ſ", "ı", "İ", "K"}


def test_keys_of_duplicates_are_made_once(spark):
    rows = spark.range(12).select("id", F.sha2((F.col("id") % 5).cast("string"), 256).alias("fingerprint"), F.lit("b").alias("buyer_key"), (F.col("id") % 7).cast("string").alias("normalized_tender_number"), F.current_date().alias("closing_day"), F.concat(F.lit("t "), (F.col("id") % 3).cast("string")).alias("title"))
    links = duplicate_links(rows.where("id < 11"))
    assert "sha2(" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert {r.cluster for r in clusters(rows, links).where("id < 11").collect()} == {0} and duplicate_links(rows.where("id in (1, 5)").withColumn("buyer_key", F.col("fingerprint"))).count() == 0


def test_upsert_shuffles_and_sorts_arrivals_no_more_than_needed(spark, monkeypatch):
    from procurelake.operators import versions as V

    written = []
    monkeypatch.setattr(V, "stash", lambda df, name, stash=V.stash: written.append((name, df.columns, df._jdf.queryExecution().executedPlan().toString())) or stash(df, name))
    rows = spark.createDataFrame([("k", "f", "a", ["u"], 1), ("k", "f", "b", ["v"], 2)], "natural_key string, fingerprint string, title string, source_urls array<string>, seen_at long")
    none = rows.drop("seen_at").select(F.lit("").alias("tender_id"), F.lit(0).alias("version_no"), "*").where("false")
    state, _ = V.upsert(none, rows)
    assert [(r.version_no, r.title, r.source_urls) for r in state.collect()] == [(2, "b", ["u", "v"])]
    # distinct keys are written by hashing; versions are counted where the windows are, not after the join
    assert any(name == "pairs" and "SortAggregate" not in plan for name, _, plan in written)
    assert all("version_no" in columns for name, columns, _ in written if name == "steps")
