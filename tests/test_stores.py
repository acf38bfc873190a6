"""Stored tables: what a batch reads and rewrites, batches that are run again, jobs that die half-way."""

from __future__ import annotations

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import types as T

from procurelake.operators import stores
from procurelake.operators.versions import insert_ignore, upsert
from procurelake.streaming import twins

ROWS = "ocid string, release_id string, raw string"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_unique_table_against_insert_ignore(spark, tmp_path):
    schema = T._parse_datatype_string(ROWS)
    table = stores.UniqueTable(spark, f"file://{tmp_path}/t", schema, ["ocid", "release_id"], buckets=4, bits=1 << 12)
    rng = random.Random(4)
    plain = spark.createDataFrame([], schema)
    for n in range(4):
        rows = [(rng.choice([f"o{rng.randrange(60)}", None]) if rng.random() < 0.9 else "", f"r{rng.randrange(3)}", f"{n}-{i:03}") for i in range(80)]
        batch = spark.createDataFrame(rows, schema)
        want = insert_ignore(plain, batch, ["ocid", "release_id"], "raw")
        got = table.insert(batch, "raw")
        assert sorted(map(str, got.fresh.collect())) == sorted(map(str, want.collect()))
        plain = spark.createDataFrame(plain.collect() + want.collect(), schema)
    keyed = batch.where("ocid is not null")
    assert table.insert(keyed, "raw").fresh.count() == 0 and table.insert(batch.limit(0)).fresh.count() == 0
    assert sorted(map(str, table.all().collect())) == sorted(map(str, plain.collect()))
    before = sorted(map(str, table.all().collect()))
    table.compact()
    assert sorted(map(str, table.all().collect())) == before and table.insert(keyed, "raw").fresh.count() == 0


def test_new_keys_read_no_stored_rows(spark, tmp_path):
    """However large the table: a batch of new keys opens no bucket, one of known keys only their buckets."""
    schema = T._parse_datatype_string(ROWS)
    table = stores.UniqueTable(spark, f"{tmp_path}/t", schema, ["ocid", "release_id"], buckets=16)
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('o', id) AS ocid", "'r' AS release_id", "repeat('x', 200) AS raw")
    read = []
    for k in range(4):
        got = table.insert(make(3000 * k, 3000 * k + 3000))
        read.append(got.read)
        assert got.fresh.count() == 3000
    assert read == [[], [], [], []]
    assert len(table.insert(make(17, 18)).read) == 1 and table.all().count() == 12_000


def test_a_job_that_dies_stores_nothing_twice(spark, tmp_path, monkeypatch):
    schema = T._parse_datatype_string(ROWS)
    table = stores.UniqueTable(spark, f"{tmp_path}/t", schema, ["ocid", "release_id"], buckets=4)
    batch = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], schema)
    append = stores.Buckets.append

    def dies(self, rows):
        if self.path.endswith("rows"):
            raise OSError("executor lost")
        append(self, rows)

    monkeypatch.setattr(stores.Buckets, "append", dies)
    with pytest.raises(OSError):
        table.insert(batch)
    monkeypatch.setattr(stores.Buckets, "append", append)
    assert table.insert(batch).fresh.count() == 2 and table.insert(batch).fresh.count() == 0 and table.all().count() == 2


def test_ingest_through_the_unique_table(spark, tmp_path):
    schema = T._parse_datatype_string(ROWS)
    for rows in ([("o1", "r1", "x"), ("o1", "r1", "x"), ("o2", "r1", "y")], [("o1", "r1", "x"), ("o1", "r2", "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for run in ("one", "two"):  # the second has lost its checkpoint and reads all again
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        table = stores.UniqueTable(spark, f"{tmp_path}/out", schema, ["ocid", "release_id"], buckets=4)
        query = twins.insert_stream(source, table, f"{tmp_path}/{run}")
        query.awaitTermination(180)
        assert not query.exception(), query.exception()
        assert sorted((r.ocid, r.release_id) for r in table.all().collect()) == [("o1", "r1"), ("o1", "r2"), ("o2", "r1")]


ARRIVING = "natural_key string, fingerprint string, title string, status string, source_urls array<string>, authority_score int, seen_at int"
AT = [datetime(2026, 1, d) for d in range(1, 6)]


def arrivals(seed, n, first):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(12)}" if rng.random() < 0.7 else None, f"f{rng.randrange(30)}", rng.choice("ABC"), rng.choice(["OPEN", "CLOSED", None]), [f"u{rng.randrange(4)}"], rng.randrange(9), first + i) for i in range(n)]


def test_tender_store_against_one_fold(spark, tmp_path):
    schema = T._parse_datatype_string(ARRIVING)
    columns = T.StructType(schema.fields[:-1])
    store = stores.TenderStore(spark, f"{tmp_path}/s", columns, buckets=8)
    plain = spark.createDataFrame([], T.StructType([T.StructField("tender_id", T.StringType()), T.StructField("version_no", T.IntegerType()), *columns.fields]))
    told = []
    for n in range(3):
        batch = spark.createDataFrame(arrivals(n, 25, 100 * n), schema)
        state, versions = upsert(plain, batch)
        told += [(n, *map(str, r)) for r in versions.collect()]
        plain = spark.createDataFrame(state.select(plain.columns).collect(), plain.schema)
        for _ in range(2 if n else 1):  # the second time changes nothing, though fields went to and fro
            store.upsert(batch, n, AT[n])
            assert sorted(map(str, store.tenders().select(plain.columns).collect())) == sorted(map(str, plain.collect()))
            assert sorted((r.batch, *map(str, r[:4])) for r in store.versions().collect()) == sorted(told)
    assert {r.updated_at for r in store.tenders().collect()} <= set(AT[:3])


def test_untouched_buckets_stay(spark, tmp_path):
    schema = T._parse_datatype_string(ARRIVING)
    store = stores.TenderStore(spark, f"{tmp_path}/s", T.StructType(schema.fields[:-1]), buckets=16)
    row = lambda i, title, at: (f"k{i}", f"f{i}", title, "OPEN", ["u"], 1, at)
    assert len(store.upsert(spark.createDataFrame([row(i, "A", i) for i in range(60)], schema), 0, AT[0])) > 8
    before = files(f"{tmp_path}/s/state")
    touched = store.upsert(spark.createDataFrame([row(7, "B", 100)], schema), 1, AT[1])
    after = files(f"{tmp_path}/s/state")
    assert len(touched) == 1 and {f for f in {*before, *after} if before.get(f) != after.get(f)} and all(f"bucket={touched[0]}/" in f for f in {*before, *after} if before.get(f) != after.get(f))
    got = {r.natural_key: (r.title, r.version_no, r.updated_at) for r in store.tenders().collect()}
    assert len(got) == 60 and got["k7"] == ("B", 2, AT[1]) and got["k8"] == ("A", 1, AT[0])
    # a job that dies after the versions and before the state is repeated whole
    batch = spark.createDataFrame([row(8, "C", 200), row(8, "A", 201), row(99, "N", 202)], schema)
    replace = stores.Buckets.replace
    stores.Buckets.replace = lambda self, rows: (_ for _ in ()).throw(OSError("executor lost"))
    try:
        with pytest.raises(OSError):
            store.upsert(batch, 2, AT[2])
    finally:
        stores.Buckets.replace = replace
    store.upsert(batch, 2, AT[2])
    store.upsert(batch, 2, AT[3])
    got = {r.natural_key: (r.title, r.version_no, r.updated_at) for r in store.tenders().collect()}
    assert got["k8"] == ("A", 3, AT[2]) and got["k99"] == ("N", 1, AT[2]) and len(got) == 61
    assert sorted((r.kind, r.version_no) for r in store.versions().where("batch = 2").collect()) == [("CREATED", 1), ("DETAILS_CHANGED", 2), ("DETAILS_CHANGED", 3)]
    assert store.upsert(batch.limit(0), 3, AT[3]) == []
    assert store.history.append(store.versions().limit(0), 2) is False
