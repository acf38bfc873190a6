"""Search and alerts against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procurelake.plans import alerts as A
from procurelake.schemas import PROVENANCE
from procurelake.search import match as M
from procurelake.search.parse import STOPWORDS, SYNONYMS, expand, literal, synonym_index, tokens
from procurelake.search.stem import stem

NOW = datetime(2026, 9, 1, 8)


def test_parsing():
    assert tokens('the "site  meeting" -road works, and -"old news" 50/60') == [("site meeting", False, True), ("road", True, False), ("works", False, False), ("old news", True, True), ("50/60", False, False)]
    assert tokens(None) == [] and tokens("the of van") == [] and tokens("a or b", either=True) == [("or", False, False), ("b", False, False)]
    assert len(SYNONYMS.strip().splitlines()) == 41 and "die" in STOPWORDS
    index = synonym_index()
    assert index["pad"] == index["road"] and "bou" in index["building"] and set(index["tender"]) >= {"bid", "rft"}
    assert [len(c) for c in literal("road or bridge -old")] == [1, 2]
    road = expand("road -pad")
    # what is asked for is never excluded by a synonym
    assert ("pad",) in road[0].options and road[1].negated and road[1].options == (("pad",),)


def test_stems():
    for forms in (("supply", "supplies", "supplied"), ("construction", "constructions"), ("cleaning", "cleaned", "cleans"), ("relational", "relate")):
        assert len({stem(w) for w in forms}) == 1, forms


VOCABULARY = "road pad bridge works supply supplies bed cleaning skoonmaak item"
QUERIES = ["road", "works -bridge", '"road works"', "cleaning bed", "supply item -pad", "bridge or bed", '-"bed item" works', "50/60", "the of", "nothinghere", "-road", "building site meeting"]


def tenders(seed=3, n=120):
    rng = random.Random(seed)
    words = [*VOCABULARY.split(), "50/60", "site", "meeting", "gebou"]
    out = []
    for i in range(n):
        title, body = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(2))
        closing = rng.choice([None, NOW - timedelta(days=1), NOW + timedelta(hours=3), NOW + timedelta(days=rng.randint(1, 60))])
        out.append((i, title.title(), body if i % 7 else None, closing, rng.choice([None, 10, 90]), datetime(2026, 8, 1) + timedelta(days=i % 9)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, description string, closing_at timestamp, authority_score int, published_at timestamp").repartition(3)


def words(text):
    import re

    return re.findall(r"\w+", (text or "").lower())


def held(terms, bag, form=str):
    def has(o):
        o = [form(w) for w in o]
        return any(bag[i : i + len(o)] == o for i in range(len(bag)))

    return all(any(has(o) for o in t.options) != t.negated for t in terms)


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_find_what_a_scan_finds(spark, stemmed):
    rows = tenders()
    form = stem if stemmed else str
    indexed, stored = M.stored_index(frame(spark, rows), {"title": "A", "description": "B"}, stemmed=stemmed)
    for q in QUERIES:
        terms = expand(q)
        # fields lie one place apart, so no phrase runs from one into the other
        want = {r[0] for r in rows if held(terms, [form(w) for w in words(r[1])] + [None] + [form(w) for w in words(r[2])], form)}
        got = {r.id for r in M.match_relation(indexed, q, stemmed=stemmed, stored=stored)[0].collect()}
        assert got == want, q
    both = [M.match_relation(indexed, q, stemmed=stemmed, stored=s)[0].count() for q in QUERIES if '"' not in q and "/" not in q for s in (None, stored)]
    assert both[::2] == both[1::2]


def plain_rank(query, lexemes):
    """Every stretch tried: the shortest that hold all groups and of which none lies in another."""
    groups = [{w} for c in literal(query) for t in c if not t.negated for o in t.options for w in o]
    hits = sorted((x["pos"], M.LABELS[x["label"]], x["lexeme"]) for x in lexemes if any(x["lexeme"] in g for g in groups))
    whole = lambda part: all(any(h[2] in g for h in part) for g in groups)
    covers = [(a, b) for a in range(len(hits)) for b in range(a, len(hits)) if groups and whole(hits[a : b + 1]) and not whole(hits[a + 1 : b + 1]) and not whole(hits[a:b])]
    total = 0.0
    for a, b in covers:
        part = hits[a : b + 1]
        total += len(part) / sum(1 / h[1] for h in part) / (1 + max(0, part[-1][0] - part[0][0] - (len(part) - 1)))
    return total / (1 + total)


def test_page_against_plain_scores(spark):
    rows = tenders(seed=8)
    indexed, stored = M.stored_index(frame(spark, rows), {"title": "A", "description": "B"})
    query = "road works"
    as_of = F.lit(NOW)
    page = M.search(indexed, query, as_of, limit=15, offset=5, stored=stored).collect()

    def score(r):
        seconds = (r.closing_at - NOW).total_seconds() if r.closing_at else None
        urgency = 0.15 if seconds is None else 0 if seconds <= 0 else 0.35 if seconds < 12 * 3600 else 1 - seconds / (30 * 86400) if seconds < 30 * 86400 else 0.1
        shares = M.Weights().shares()
        return shares[0] * plain_rank(query, [x.asDict() for x in r.lexemes]) + shares[1] * (r.authority_score if r.authority_score is not None else 50) / 100 + shares[2] * urgency

    found = [r for r in indexed.collect() if held(expand(query), words(r.title) + [None] + words(r.description))]
    want = sorted(((-score(r), r.closing_at or datetime.max, r.id) for r in found))[5:20]
    assert [r.id for r in page] == [w[2] for w in want] and [r.score for r in page] == pytest.approx([-w[0] for w in want])
    browsed = M.search(indexed, "the", as_of, limit=7)
    assert browsed.count() == 7 and {r.score for r in browsed.collect()} == {None}
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            M.search(indexed, query, as_of, **bad)
    for bad in ({"province": "Atlantis"}, {"status": "LOST"}):
        with pytest.raises(ValueError):
            M.filters(**bad)


def test_headlines(spark):
    rows = [(1, "Road & <works>", "far " * 60 + "the road is closed for supplies " + "away " * 60), (2, "Nothing", "else"), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    got = {r.id: r for r in M.with_headline(df, "roads supply").collect()}
    assert got[1].title_highlight == "<mark>Road</mark> &amp; &lt;works&gt;"
    assert "<mark>road</mark> is closed for <mark>supplies</mark>" in got[1].snippet and len(got[1].snippet.split()) <= 40
    assert got[2].title_highlight == "Nothing" and got[2].snippet is None and got[3].snippet is None
    assert {r.snippet for r in M.with_headline(df, "").collect()} == {None}


def test_vectors_in_search(spark):
    indexed = M.with_index(frame(spark, [(1, "road", None, None, 50, NOW), (2, "road", None, None, 50, NOW), (3, "road", None, None, 50, NOW)]), {"title": "A"})
    made = M.embed_pending(indexed.withColumn("buyer_name", F.lit("b")), spark.createDataFrame([(2, "m", [0.0, 1.0]), (3, "other", [1.0, 0.0])], "tender_id long, model string, embedding array<float>"), "m", lambda texts: [[1.0, 0.0]] * len(texts), 2)
    assert sorted(r.tender_id for r in made.collect()) == [1, 3] and {r.model for r in made.collect()} == {"m"}
    stored = made.select("tender_id", "model", "embedding").unionByName(spark.createDataFrame([(2, "m", [0.0, 1.0]), (2, "other", [1.0, 0.0])], "tender_id long, model string, embedding array<float>"))
    page = M.search(indexed, "road", F.lit(NOW), vector=[1.0, 0.0], embeddings=stored, model="m").collect()
    assert [r.id for r in page] == [1, 3, 2] and page[0].score > page[2].score and len(page) == 3
    with pytest.raises(Exception, match="needs 3 numbers"):
        M.embed_pending(indexed.withColumn("buyer_name", F.lit("b")), stored, "new", lambda texts: [[1.0]] * len(texts), 3).collect()


def test_projection(spark):
    rows = frame(spark, [(1, "road", None, None, 50, NOW), (2, "pad", None, None, 50, NOW)])
    other = {c: F.lit(None).cast("string") for c in M.PROJECTION if c not in rows.columns}
    df = rows.withColumns(other).withColumns({"buyer_org_id": F.when(F.col("id") == 1, F.lit(7)), "internal": F.lit("x")})
    got = M.projected(df, spark.createDataFrame([(7, "City")], "id int, name string"))
    assert got.columns == list(M.PROJECTION) and len(got.columns) == 17 and {r.id: r.buyer_name for r in got.collect()} == {1: "City", 2: None}


# alerts


def alert_tables(spark):
    rng = random.Random(12)
    provinces, categories = ["Gauteng", "Limpopo", "Free State"], ["goods", "works"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(VOCABULARY.split()) for _ in range(rng.randint(0, 5)))
        conf = rng.choice([None, 0.5, 0.98])
        rows.append((i, text, rng.choice([*provinces, None]), rng.sample(categories, rng.randint(0, 2)) if i % 11 else None, rng.choice(["OPEN", "CLOSED", "NEW"]),
                     rng.choice([None, NOW + timedelta(days=rng.randint(-5, 40))]), NOW - timedelta(days=rng.randint(0, 9)), {"closing_at": ("S", "s", conf, None)} if conf else None))
    df = spark.createDataFrame(rows, f"id long, title string, province string, categories array<string>, status string, closing_at timestamp, created_at timestamp, field_provenance map<string,{PROVENANCE}>")
    asks = ["road", "works -bridge", '"road works"', "bridge or bed", "-road -bed", "", None, "nothinghere", "supply supply"]
    alerts = []
    for a in range(60):
        alerts.append((a, rng.choice(asks), rng.choice([None, [], ["Gauteng"], ["Gauteng", "Limpopo"]]), rng.choice([None, [], ["works"], ["goods", "works"]]), rng.choice([None, 7, 30]), a % 9 != 0))
    sent = [(rng.randrange(60), rng.randrange(150)) for _ in range(400)]
    return rows, df, alerts, sent


def test_alerts_against_plain_loops(spark):
    rows, df, alerts, sent = alert_tables(spark)
    want = set()
    gone = set(sent)
    for alert, keywords, provinces, categories, days, active in alerts:
        if not active or not ((keywords or "").strip() or provinces or categories):
            continue
        fit = []
        for i, title, province, own, status, closing, created, prov in rows:
            ok = status in A.ALERTABLE and (alert, i) not in gone
            ok = ok and (not provinces or province in provinces) and (not categories or bool(set(categories) & set(own or [])))
            if (keywords or "").strip():
                ok = ok and any(held(c, words(title)) for c in literal(keywords))
            if days is not None:
                ok = ok and bool(prov) and (prov["closing_at"][2] or 0) >= 0.8 and closing is not None and NOW <= closing <= NOW + timedelta(days=days)
            if ok:
                fit.append((closing is None, closing or NOW, -created.timestamp(), i))
        want |= {(alert, x[3], k) for k, x in enumerate(sorted(fit)[:6], 1)}
    indexed = M.with_index(df, {"title": "A"})
    alert_rows = spark.createDataFrame(alerts, "alert_id long, keywords string, provinces array<string>, categories array<string>, closing_within_days int, active boolean")
    matched = A.match_alerts(alert_rows, indexed, spark.createDataFrame(sent, "alert_id long, tender_id long"), F.lit(NOW), limit=6)
    got = {(r.alert_id, r.tender_id, r.rank) for r in matched.collect()}
    assert got == want and len(want) > 60
    summary = A.run_summary(matched).first()
    assert (summary.alerts_matched, summary.tenders_matched) == (len({a for a, *_ in want}), len(want))
    assert A.match_alerts(alert_rows.limit(0), indexed, spark.createDataFrame([], "alert_id long, tender_id long"), F.lit(NOW)).count() == 0


def test_digests(spark):
    prov = lambda c: {"closing_at": ("S", "s", c, None)}
    tenders = spark.createDataFrame(
        [
            (1, "Road", "SCM 1/26", "City", "Gauteng", datetime(2026, 9, 15, 9), prov(0.98), True, "https://x/1"),
            (2, "Bridge", None, None, None, datetime(2026, 9, 16, 9), prov(0.5), False, None),
            (3, "Pumps", "", "", "", None, prov(0.9), None, "https://x/3"),
        ],
        f"id long, title string, tender_number string, buyer_name string, province string, closing_at timestamp, field_provenance map<string,{PROVENANCE}>, compulsory_briefing boolean, original_url string",
    )
    matched = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (8, 3, 1)], "alert_id long, tender_id long, rank int")
    alerts = spark.createDataFrame([(7, " road ", "Ann"), (8, None, None)], "alert_id long, keywords string, user_name string")
    got = {r.alert_id: r for r in A.render_digests(matched, tenders, alerts, "Brand", "https://b").collect()}
    assert got[7].subject == "Brand: 2 new tenders for “road”" and got[8].subject == "Brand: 1 new tender for “your saved search”"
    assert got[7].body.splitlines() == [
        "Hi Ann,", "", "2 new tenders match your alert (road):", "", "• Bridge", "  Unknown buyer", "  Closing date UNVERIFIED — verify at source before relying on it", "  https://b/tender/2", "",
        "• SCM 1/26 — Road", "  City · Gauteng", "  Closes: 15 Sep 2026, 11:00 SAST", "  ⚠ COMPULSORY briefing — missing it disqualifies your bid", "  https://b/tender/1", "",
        "—", "Brand aggregates official sources and always links to the original.", "eTender OCDS data © National Treasury, CC BY 4.0.", "Manage your alerts: https://b/alerts",
    ]
    plain = {r.alert_id: r.body for r in A.render_digests(matched, tenders, alerts, "Brand").collect()}
    assert "Hi,\n\n1 new tender matches your alert (your saved search):" in plain[8] and "  Closes: no date published\n  https://x/3\n" in plain[8] and plain[8].endswith("Brand → Alerts")


def test_postings_are_made_without_a_shuffle_and_repeated_ids_are_united(spark):
    rows = [(1, "b a b"), (2, None), (3, "a"), (4, ""), (None, "x")]
    once = M.postings(M.with_index(spark.createDataFrame(rows, "id long, text string"), {"text": "B"}))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    flat = lambda p: sorted((r.lexeme, r.id if r.id is not None else -1, [(x.pos, x.label) for x in r.positions]) for r in p.collect())
    assert flat(once) == [("a", 1, [(2, "B")]), ("a", 3, [(1, "B")]), ("b", 1, [(1, "B"), (3, "B")]), ("x", -1, [(1, "B")])]
    twice = M.postings(M.with_index(spark.createDataFrame([*rows, (1, "c b"), (None, "x")], "id long, text string"), {"text": "B"}))
    assert flat(twice) == [("a", 1, [(2, "B")]), ("a", 3, [(1, "B")]), ("b", 1, [(1, "B"), (2, "B"), (3, "B")]), ("c", 1, [(1, "B")]), ("x", -1, [(1, "B"), (1, "B")])]


def test_alerts_that_were_sent_much_do_not_make_the_others_look_far(spark):
    """Places are counted by days to the depth asked for, and an alert that was sent much still gets what comes next."""
    start = datetime(2026, 3, 1)
    rows = [(i % 2, i, None if i % 9 == 0 else start + timedelta(hours=7 * (i % 40)), start - timedelta(hours=5 * (i % 30))) for i in range(600)]
    fit = spark.createDataFrame(rows, "asked long, tender_id long, closing_at timestamp, created_at timestamp")
    got = A.first_of_each(fit, spark.createDataFrame([(0, 280), (1, 3)], "asked long, depth long")).collect()
    order = lambda r: (r[2] is None, r[2] or start, -r[3].timestamp(), r[1])
    for asked, depth, most in ((0, 280, 300), (1, 3, 40)):
        want = [r[1] for r in sorted((r for r in rows if r[0] == asked), key=order)]
        mine = {r.k: r.tender_id for r in got if r.asked == asked}
        assert depth <= len(mine) <= most and mine == {k + 1: want[k] for k in range(len(mine))}


def test_counts_of_tenders_that_alerts_meet(spark):
    """Stored clauses lie under the word that is rarest among the tenders, not the longest, and an alert of several clauses counts a tender once."""
    from procurelake.streaming.alert_stream import counts_met, matched, stored_clauses

    fields = "id long, title string, province string, status string, categories array<string>, closing_at timestamp, created_at timestamp"
    rows = [(i, f"common w{i % 5}", ("Gauteng", "Limpopo")[i % 2], "OPEN", ["a", "b"], None, None) for i in range(40)]
    t = M.with_index(spark.createDataFrame(rows, fields), {"title": "A"}).withColumn("field_provenance", F.create_map().cast("map<string,struct<source:string,source_id:string,confidence:double,note:string>>"))
    asks = [(1, "common w3", None, None), (2, "common or w3", None, None), (3, None, ["Gauteng", "Limpopo"], None), (4, None, None, ["a", "b"]), (5, "w3 -common", None, None)]
    alerts = spark.createDataFrame([(*a, None, True) for a in asks], "alert_id long, keywords string, provinces array<string>, categories array<string>, closing_within_days int, active boolean")
    clauses = stored_clauses(alerts, A.word_frequencies(t))
    assert {r.key for r in clauses.where("alert_id = 1").collect()} == {"w:w3"}
    now = F.lit(datetime(2026, 3, 1))
    pairs = matched(t, clauses, now).select("alert_id", "tender_id").distinct().groupBy("alert_id").count().collect()
    got = {r.alert_id: (r.n, r.first_id, r.last_id) for r in counts_met(t, clauses, now).collect()}
    assert got == {1: (8, 3, 38), 2: (40, 0, 39), 3: (40, 0, 39), 4: (40, 0, 39)} and {r["alert_id"]: r["count"] for r in pairs} == {a: n for a, (n, _, _) in got.items()}


def test_a_word_is_stemmed_once_a_batch(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(M, "stem", lambda w: seen.append(w) or stem(w))
    lists = [["supplies", "items", "supplies"], None, [], ["items"], ["roads"]]
    kept = lambda x: [stem(w) for w in x] if x is not None else None
    assert M.stem_lists(pa.array(lists, pa.list_(pa.string()))).to_pylist() == [kept(x) for x in lists]
    assert M.stem_lists(pa.array(lists, pa.list_(pa.string())).slice(1, 3)).to_pylist() == [kept(x) for x in lists[1:4]]
    assert sorted(seen) == ["items", "items", "roads", "supplies"]
    assert M.stem_lists(pa.array([], pa.list_(pa.string()))).to_pylist() == []
