"""Operators on pairs (2, 3, 7) against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurelake.llm.exact_dedup import build_index, drop_copies, exact_dedup
from procurelake.llm.near_join import keep_one_of_each_class, near_duplicates, prefix_depth
from procurelake.llm.shared import components
from procurelake.llm.vector_dedup import compared, near_vectors


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 200), (200, 250), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# n-gram Jaccard join


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + ["", "   ", "one", "One", "two words", "Two  words", texts[0].upper()] + [None, None]


def jaccard_links(texts):
    def shingles(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [shingles(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]


def test_near_join_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)], "doc_id long, text string, n int, cluster string").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    links = jaccard_links(texts)
    root = union_find(len(texts), links)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.class_id == root[i] and r.kept == (root[i] == i)
        assert r.n_links == sum(i in p for p in links)
    kept = keep_one_of_each_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*root})


def test_near_join_of_one_large_group(spark, monkeypatch):
    """A group over many blocks loses no link."""
    monkeypatch.setattr("procurelake.llm.near_join.BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    links = jaccard_links(texts)
    root = union_find(60, links)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (root[i], sum(i in p for p in links)) for i in range(60)}


def test_near_join_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (5, None)], "doc_id long, text string")
    got = near_duplicates(twice).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.n_links for r in got) == [0, 2, 2, 2]


def test_near_join_keeps_rows_of_repeated_and_null_ids(spark):
    rows = [(4, "a b c"), (4, "a  b c"), (4, "quite another text"), (None, "x y z"), (None, "X y  z"), (None, None), (2, "one two"), (3, "one  two")]
    kept = keep_one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"))
    words = sorted(((r.doc_id or 0), " ".join((r.text or "").lower().split())) for r in kept.collect())
    assert words == [(0, ""), (0, "x y z"), (2, "one two"), (4, "a b c"), (4, "quite another text")]


def test_depth_meets_recall():
    depth = prefix_depth(24, 8, 0.8, 0.99999)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.99999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


# embeddings


def vectors(seed=5, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(25):
        base = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 8))):
            out.append(((base + rng.normal(size=dims) * 0.09).astype("f4").tolist(), k % 3))
    out += [(out[0][0], out[0][1]), (out[0][0], 99), (out[0][0], None), (None, 1), ([0.0] * dims, 1), ([float("nan")] * dims, 1), ([None] * dims, 1), ([float("inf")] + [1.0] * (dims - 1), 1), ([], 1)]
    return out


def cosine_links(rows):
    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, (v, a) in enumerate(rows):
        for j, (w, b) in enumerate(rows[:i]):
            if a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v, "f8"), np.array(w, "f8")
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("block", [256, 4])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("procurelake.llm.vector_dedup.BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, k, "x") for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    links = cosine_links(rows)
    root = union_find(len(rows), links)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(i in p for p in links), root[i], root[i] == i), i


def check_vectors(spark, rows):
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    v, label = np.array([v for v, _ in rows]), np.array([k for _, k in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = union_find(len(rows), np.argwhere(linked).tolist())
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(n), root[i]) for i, n in enumerate(linked.sum(1))}


def test_vectors_of_two_dense_clumps(spark):
    """Two clumps that fill every list with their own are linked with each other too."""
    rng, dims = np.random.default_rng(2), 64
    base = np.eye(dims)[:2]
    rows = []
    for centre in (base[0], 0.985 * base[0] + (1 - 0.985**2) ** 0.5 * base[1]):
        rows += [((centre + rng.normal(size=dims) * 0.002).tolist(), 1) for _ in range(20)]
    check_vectors(spark, rows)


def test_vectors_of_a_hot_label(spark):
    """Among many small labels, the isolated pairs of one large label are all found."""
    rng, dims = np.random.default_rng(4), 64
    rows = [(rng.normal(size=dims).tolist(), k) for k in range(1, 401)]
    for _ in range(1000):
        v = rng.normal(size=dims)
        rows += [(v.tolist(), 0), ((v + rng.normal(size=dims) * 0.15).tolist(), 0)]
    check_vectors(spark, rows)


def test_vectors_below_the_audit_target(spark, monkeypatch):
    """With far too few trees and rounds, the labels are compared whole."""
    monkeypatch.setattr("procurelake.llm.vector_dedup.TREES", 1)
    monkeypatch.setattr("procurelake.llm.vector_dedup.ROUNDS", 1)
    monkeypatch.setattr("procurelake.llm.vector_dedup.LEAF", 4)
    monkeypatch.setattr("procurelake.llm.vector_dedup.TRIES", 0)
    calls = []
    monkeypatch.setattr("procurelake.llm.vector_dedup.compared", lambda *args: calls.append(1) or compared(*args))
    rng, dims = np.random.default_rng(6), 64
    rows = []
    for _ in range(200):
        v = rng.normal(size=dims)
        rows += [(v.tolist(), 0), ((v + rng.normal(size=dims) * 0.15).tolist(), 0)]
    check_vectors(spark, rows)
    assert calls


def test_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# exact dedup

COPIES = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "ÄB"), (7, "äb"), (8, "äB"), (9, "x" * 200_000), (10, "X" * 200_000), (11, "alone"), (11, "alone"), (None, "alone")]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in COPIES], "doc_id long, text string, n int, bucket string").repartition(3)
    got = exact_dedup(df).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in COPIES:
        groups.setdefault(low(t), []).append(i)
    digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(COPIES)
    for r in got:
        mine = digest[r.text_sha256]
        assert r.group_size == len(mine) and r.keep_id == max(i for i in mine if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    stay = drop_copies(df)
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact_dedup(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0


def test_index_chains_collisions_and_splits(spark):
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    few = lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(8)), 61)  # noqa: E731  keys collide on purpose
    index = build_index(df, capacity=6, max_depth=4, key=few).collect()
    assert len(index) == 40 and all(r.n == 2 for r in index)
    assert {r.chain for r in index} != {0} and len({(r.bucket, r.key, r.chain) for r in index}) == 40
    assert max(r.depth for r in index) > 0
    got = exact_dedup(df, capacity=6, max_depth=4, key=few).collect()
    assert all(r.keep_id == r.doc_id % 40 + 40 and r.group_size == 2 for r in got)
