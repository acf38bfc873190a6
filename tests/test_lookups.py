"""Vector lists, trigrams and growing clusters against plain scans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurelake.operators.growing import GrowingClusters
from procurelake.search import trigrams, vector_index


def test_vector_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    points = centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    points[7] = points[50]  # a tie
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1e-200 * float(x) for x in points[3]])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    index = vector_index.VectorLists(spark, f"file://{tmp_path}/v").build(df, lists=16, sample=800)
    queries = df.where("id % 50 = 0 or id > 1999").select(F.col("id").alias("query"), "embedding")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {}
    for q in range(0, 1500, 50):
        sims = np.round(np.append(unit, unit[3:4], 0) @ unit[q], 12)
        want[q] = [(2003 if i == 1500 else i) for i in np.argsort(-sims, kind="stable")[:20].tolist()]
    exact = index.search(queries, 20, None).collect()
    got = {}
    for r in sorted(exact, key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["key"])
    assert {q: v for q, v in got.items() if q < 1500} == want and {q for q in got if q > 1500} == {2003}
    # the lists that the audit chose hold nine tenths of the neighbours at least: few where there are clusters, most where there are none
    probes, recall = index.audit()
    met = sum((r["key"] in want[r["query"]]) for r in index.search(queries, 20).collect() if r["query"] < 1500)
    assert met / (20 * len(want)) >= 0.9 and recall >= 0.95 and probes <= 8
    loose = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 16)))], "id long, embedding array<double>")
    other = vector_index.VectorLists(spark, f"{tmp_path}/loose").build(loose, lists=16)
    ask = loose.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    near = [{(r["query"], r["key"]) for r in other.search(ask, 20, p).collect()} for p in (None, vector_index.CHOSEN)]
    assert len(near[0] & near[1]) >= 0.9 * len(near[0]) and other.audit()[0] > probes
    # lists that nobody asks for are not read
    one = index.search(queries.where("query = 0"), 5, 1)
    assert one.count() == 5 and "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString()
    empty = vector_index.VectorLists(spark, f"{tmp_path}/none").build(df.limit(0))
    assert empty.search(queries, 3).count() == 0 and empty.search(queries, 3, None).count() == 0
    few = vector_index.VectorLists(spark, f"{tmp_path}/few").build(df.where("id in (1, 2)"))
    assert few.search(queries.where("query = 0"), 3).count() == 2


def test_all_lists_meet_their_vectors_in_many_tasks(spark, tmp_path, monkeypatch):
    """Lists and those that ask for them are dealt alike; queries that are cut into parts find the same."""
    points = np.random.default_rng(3).normal(size=(400, 8))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {(q, int(k)) for q in range(0, 400, 50) for k in np.argsort(-np.round(unit @ unit[q], 12), kind="stable")[:5]}
    queries = df.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = vector_index.VectorLists(spark, f"file://{tmp_path}/dealt").build(df, lists=16)
        for asked, tile in ((vector_index.ASKED, vector_index.TILE), (3, 20)):
            monkeypatch.setattr(vector_index, "ASKED", asked, raising=False)
            monkeypatch.setattr(vector_index, "TILE", tile, raising=False)
            assert {(r["query"], r["key"]) for r in index.search(queries, 5, None).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def names(spark):
    said = ["City of Cape Town", "CITY", "ci", "", None, "50% off_ltd", "İstanbul Kelvin K", "Straße der Arbeit", "ab", "Cape", "capetown city", "a\\b%c"]
    return spark.createDataFrame([(n,) for n in said * 2], "name string")


@pytest.mark.parametrize("pattern", ["%cape%", "%CITY%", "ci%", "%c_ty%town%", "%", "", "%ab%", "50\\% off\\_%", "%kelvin k%", "%straße%", "%STRASSE%", "%nothing%", "city", "%a\\\\b\\%c"])
def test_names_like_a_pattern(spark, names, pattern):
    stored = trigrams.trigram_postings(names)
    got = sorted(r.name for r in trigrams.names_like(stored, names, pattern).collect())
    assert got == sorted({r.name for r in names.where(F.col("name").ilike(pattern)).collect()})


def test_pieces():
    assert trigrams.pieces("%Ab\\%c_d\\\\%") == ["ab%c", "d\\"] and trigrams.wanted_trigrams("%cape%t_wn%") == ["ape", "cap"]


def test_clusters_grow_as_the_whole_run_has_them(spark, tmp_path):
    rng = random.Random(5)
    store = GrowingClusters(spark, f"{tmp_path}/g", buckets=4)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n in range(4):
        links = [(rng.randrange(80), rng.randrange(80)) for _ in range(14)] + [(100 + n, 100 + n), (None, 3)]
        if n == 3:
            links += [(i, i + 1) for i in range(0, 60, 2)]
        for a, b in links:
            if a is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        batch = spark.createDataFrame(links, "a long, b long")
        store.add(batch)
        if n == 1:
            store.add(batch)  # adds nothing
        if n == 2:
            store.compress()
        assert dict(map(tuple, store.clusters().collect())) == {x: find(x) for x in root}
    store.add(batch.limit(0))
    assert dict(map(tuple, store.clusters().collect())) == {x: find(x) for x in root}
