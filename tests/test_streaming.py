"""The incremental twins, run on files as streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from procurelake.plans.health import episode_stamps
from procurelake.streaming import twins

START = datetime(2026, 1, 1)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(query):
    query.awaitTermination(180)
    assert not query.exception(), query.exception()


CHECKS = "source_id string, checked_at timestamp, ok boolean"


def test_episode_stamps(spark, tmp_path):
    said = {"a": "1001101", "b": "0000", "c": "1"}
    rows = [(s, START + timedelta(minutes=i), x == "1") for s, xs in said.items() for i, x in enumerate(xs)]
    put(spark, f"{tmp_path}/in", [r for r in rows if r[1] < START + timedelta(minutes=3)], CHECKS)
    put(spark, f"{tmp_path}/in", [r for r in rows if r[1] >= START + timedelta(minutes=3)], CHECKS)
    stamped = twins.stamp_episodes(stream(spark, f"{tmp_path}/in", CHECKS))
    drain(stamped.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start())
    got = {(r.source_id, r.checked_at): r.mttd_started_at for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.source_id, r.checked_at): r.mttd_started_at for r in episode_stamps(spark.createDataFrame(rows, CHECKS)).collect()}
    assert got == want and len(got) == len(rows)


def test_ingest_is_idempotent(spark, tmp_path):
    schema = "ocid string, release_id string, raw string"
    put(spark, f"{tmp_path}/in", [("o1", "r1", "x"), ("o1", "r1", "x"), ("o2", "r1", "y"), (None, "r9", "z")], schema)
    put(spark, f"{tmp_path}/in", [("o1", "r1", "x"), ("o1", "r2", "x")], schema)
    for run in ("one", "two"):  # the second has lost its checkpoint and reads all again
        drain(twins.ingest_releases(stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/{run}"))
        assert sorted((r.ocid, r.release_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("o1", "r1"), ("o1", "r2"), ("o2", "r1")]


def test_alert_events_at_most_once(spark, tmp_path):
    store = twins.append_new(["alert_id", "tender_id"], f"{tmp_path}/sent")
    batch = spark.createDataFrame([(1, 10), (1, 11), (1, 10)], "alert_id long, tender_id long")
    for n in (0, 0, 1):  # a batch that is run again adds nothing
        store(batch, n)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/sent").collect())) == [(1, 10), (1, 11)]


def test_windows_with_a_watermark(spark, tmp_path):
    rows = [("a", START + timedelta(minutes=m), m % 3 > 0) for m in range(0, 180, 10)]
    put(spark, f"{tmp_path}/in", rows, CHECKS)
    put(spark, f"{tmp_path}/in", [("a", START + timedelta(hours=9), True)], CHECKS)
    put(spark, f"{tmp_path}/in", [("a", START + timedelta(hours=10), True), ("a", START, False)], CHECKS)  # the last is late
    counted = twins.failures_by_window(stream(spark, f"{tmp_path}/in", CHECKS))
    drain(counted.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    got = {r.window.start: (r.failures, r.checks) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {START + timedelta(hours=h): (sum(not ok for _, at, ok in rows if at.hour == h), 6) for h in range(3)}
    assert {k: v for k, v in got.items() if k in want} == want


def test_backoff_timers(spark, tmp_path):
    schema = "job_id long, at timestamp, ok boolean"
    at = lambda m: START + timedelta(minutes=m)
    put(spark, f"{tmp_path}/in", [(1, at(0), False), (2, at(0), False), (2, at(20), True), (3, at(0), False), (3, at(15), False)], schema)
    put(spark, f"{tmp_path}/in", [(1, at(15), False), (3, at(45), False), (3, at(105), False), (3, at(230), False)], schema)
    seen = []
    states = twins.backoff_timers(stream(spark, f"{tmp_path}/in", schema))
    keep = lambda batch, n: seen.extend((n, r.job_id, r.attempts, r.state, r.retry_at) for r in batch.collect())
    drain(states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    got = {j: [(a, s, t) for n, k, a, s, t in sorted(seen, key=lambda x: x[0]) if k == j] for j in (1, 2, 3)}
    assert got[1] == [(1, "RETRY_BACKOFF", at(15)), (2, "RETRY_BACKOFF", at(45))]
    assert got[2] == [(0, "DONE", None)]
    assert got[3] == [(2, "RETRY_BACKOFF", at(45)), (5, "FAILED", None)]


def test_poll_loop(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("s1",), ("s2",)], "source_id string")
    put(spark, f"{tmp_path}/in", [("s1",)], "source_id string")
    fetch = lambda batch: batch.select("source_id", F.concat(F.lit("https://"), "source_id").alias("source_url"))
    drain(twins.poll(stream(spark, f"{tmp_path}/in", "source_id string"), fetch, f"{tmp_path}/out", ["source_id", "source_url"], f"{tmp_path}/ck"))
    assert sorted(r.source_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["s1", "s2"]
