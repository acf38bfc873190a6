"""Alerts on a stream and an index kept up to date, against what one pass over everything gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procurelake.operators.stores import History
from procurelake.plans.alerts import match_alerts
from procurelake.schemas import PROVENANCE
from procurelake.search import match as M
from procurelake.search.parse import expand
from procurelake.search.store import IndexStore
from procurelake.streaming.alert_stream import alert_events, outbox, stored_clauses

NOW = datetime(2026, 1, 1)
TENDERS = f"id long, title string, province string, categories array<string>, status string, closing_at timestamp, created_at timestamp, field_provenance map<string,{PROVENANCE}>"
ALERTS = "alert_id long, keywords string, provinces array<string>, categories array<string>, closing_within_days int, active boolean"


def some_tenders(rng):
    rows = []
    for i in range(90):
        closing = None if i % 7 == 0 else NOW + timedelta(days=rng.randrange(-5, 60))
        prov = None if i % 11 == 0 else {"closing_at": ("SOURCE", "s", rng.choice([0.5, 0.9]), None)}
        rows.append((i, " ".join(rng.choices("road works pump water supply phase two".split(), k=5)), rng.choice(["G", "L", None]), rng.choice([[], None, ["x"], ["x", "y", "x"]]), rng.choice(["OPEN", "NEW", "CLOSED", "CANCELLED"]), closing, NOW, prov))
    return rows


ASKED = [
    (1, "road pump", None, None, None, True), (2, '"water supply"', ["G"], None, None, True), (3, "-road", None, None, 30, True), (4, "pump or phase -two", None, ["x"], None, True), (5, None, ["G", "L", "G"], None, None, True),
    (6, "", [], ["y", "x"], 20, True), (7, None, None, None, None, True), (8, "road", None, None, None, False), (9, "road", ["L"], ["y"], 40, True), (10, "unheard", None, None, None, True),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_alerts_equals_one_match(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = some_tenders(random.Random(0))
    alerts = spark.createDataFrame(ASKED, ALERTS)
    sent = spark.createDataFrame([(1, i) for i in range(0, 90, 4)] + [(5, 3)], "alert_id long, tender_id long")
    whole = M.with_index(spark.createDataFrame(rows, TENDERS), {"title": "A"})
    want = sorted(map(tuple, match_alerts(alerts, whole, sent, F.lit(NOW), limit=10_000).select("alert_id", "tender_id").collect()))
    again = rows + rng.sample(rows, 30)  # some tenders come twice
    rng.shuffle(again)
    cut = sorted(rng.sample(range(1, len(again)), 2 if seed == 1 else 3))
    for lo, hi in zip([0, *cut], [*cut, len(again)], strict=True):
        spark.createDataFrame(again[lo:hi], TENDERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(TENDERS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    frequencies = spark.createDataFrame([("road", 5), ("pump", 9)], "lexeme string, n long") if seed == 1 else None
    events = alert_events(M.with_index(stream, {"title": "A"}), stored_clauses(alerts, frequencies), F.lit(NOW), sent)
    box = History(spark, f"{tmp_path}/box")
    out = f"{tmp_path}/events"
    if seed == 1:
        query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    else:
        query = outbox(events, whole, box, f"{tmp_path}/ck")
    query.awaitTermination(300)
    assert not query.exception(), query.exception()
    if seed == 1:
        assert sorted(map(tuple, spark.read.parquet(out).select("alert_id", "tender_id").collect())) == want and len(want) > 60
        assert {a for a, _ in want} >= {1, 3, 4, 5, 6}
    else:
        digests = spark.read.parquet(f"{tmp_path}/box")
        assert digests.agg(F.sum("n")).first()[0] == len(want) and digests.groupBy("alert_id", "batch").count().where("count > 1").count() == 0
        # the outbox takes a batch once
        assert box.append(digests.limit(0), 0) is False


def test_index_kept_up_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    words = "road works pump water supply phase two harbour".split()
    schema = "id long, title string, note string"
    text = lambda: " ".join(rng.choices(words, k=6))
    now = {}
    store = IndexStore(spark, f"file://{tmp_path}/ix", spark.createDataFrame([], schema).schema, {"title": "A"}, stemmed=True)
    queries = ["road pump", '"water supply" -harbour', "phases works -pumps"]

    def same():
        plain, stored = M.stored_index(spark.createDataFrame([(i, *r) for i, r in now.items()], schema), {"title": "A"}, stemmed=True)
        assert sorted(map(str, store.rows().collect())) == sorted(map(str, plain.collect()))
        assert sorted(map(str, store.postings().collect())) == sorted(map(str, stored.collect()))
        for q in queries:
            found = sorted(r.id for r in M.matching_ids(store.postings(), expand(q, {}), stemmed=True).collect())
            assert found == sorted(r.id for r in M.matching_ids(stored, expand(q, {}), stemmed=True).collect())

    for n in range(3):
        change = {rng.randrange(60): (text() if rng.random() < 0.9 else None, f"n{n}") for _ in range(40)}
        gone = rng.sample(range(60), 5 * n)
        assert store.change(spark.createDataFrame([(i, *r) for i, r in change.items()] + [(None, "no id", "x")], schema), spark.createDataFrame([(i,) for i in gone] + [(None,)], "id long"), n)
        now = {i: r for i, r in (now | change).items() if i not in gone}
    assert store.change(spark.createDataFrame([(1, "again", "x")], schema), number=2) is False  # the batch is there
    same()
    store.merge()
    assert store.numbers() == (3, [])
    store.change(removed=spark.createDataFrame([(next(iter(now)),)], "id long"))
    now.pop(next(iter(now)))
    # a change that died before its ids were written is not there, and its number is used again
    spark.createDataFrame([(500, "road", "x")], schema).write.parquet(f"{tmp_path}/ix/rows/generation=5")
    same()
    assert store.merge_if_grown() is False
    store.change(spark.createDataFrame([(i, text(), "late") for i in range(100, 140)], schema))
    assert store.numbers() == (3, [4, 5]) and store.merge_if_grown() and store.numbers() == (6, [])
    assert store.rows().count() == len(now) + 40 and store.merge_if_grown() is False


def long_texts(n=24, size=30_000):
    """Texts of more words than Spark sorts in one thread, of a vocabulary that Parquet keeps as a dictionary."""
    rng = random.Random(8)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3_000)]
    return [(i, " ".join(rng.choices(vocabulary, k=size))) for i in range(n)]


def test_postings_of_long_stored_texts(spark, tmp_path):
    rows = long_texts()
    want = {}
    for i, text in rows:
        for at, word in enumerate(text.split(), 1):
            want.setdefault((word, i), []).append(at)
    made = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    M.with_index(made, {"text": "B"}).write.parquet(f"{tmp_path}/rows")
    store = IndexStore(spark, f"file://{tmp_path}/ix", made.schema, {"text": "B"})
    store.change(made)
    for found in (M.postings_of_rows(spark.read.parquet(f"{tmp_path}/rows")), store.postings()):
        got = {(r.lexeme, r.id): [p.pos for p in r.positions] for r in found.toLocalIterator()}
        assert got == want and {p.label for p in found.first().positions} == {"B"}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_index_takes_little_disk(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("procurelake.search.store.FEW_IDS", few, raising=False)
    made = spark.createDataFrame(long_texts(60, 3_000), "id long, text string").coalesce(1)
    made.write.parquet(f"{tmp_path}/texts")
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    texts = spark.read.parquet(f"{tmp_path}/texts")
    store = IndexStore(spark, f"file://{tmp_path}/ix", texts.schema, {"text": "B"})
    # some come twice
    store.change(texts.unionByName(texts.where("id % 5 = 0")))
    store.change(texts.where("id % 3 = 0").withColumn("text", F.concat(F.lit("onan "), "text")), texts.where("id % 7 = 0").select("id"))
    assert size(tmp_path / "ix" / "rows" / "generation=0") < 1.2 * size(tmp_path / "texts")
    before = sorted(map(str, store.postings().collect())), sorted(map(str, store.rows().collect()))
    base = store.merge()
    assert store.remove_merged() == 6 and store.remove_merged() == 0
    assert size(tmp_path / "ix") < 3 * size(tmp_path / "texts")
    assert store.numbers() == (base, []) and (sorted(map(str, store.postings().collect())), sorted(map(str, store.rows().collect()))) == before
    assert sorted(r.id for r in store.rows().select("id").collect()) == [i for i in range(60) if i % 7]
    assert sorted(r.id for r in M.matching_ids(store.postings(), expand("onan", {})).collect()) == [i for i in range(60) if i % 3 == 0 and i % 7]
    store.change(texts.where("id = 7"))
    assert store.numbers() == (base, [base + 1]) and store.rows().count() == 52
