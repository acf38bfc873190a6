"""Near-duplicate vectors by NN-descent (operator 3).

Equal vectors of a label are one node. The neighbour graph starts from random-hyperplane leaves and is
refined by joins of neighbours with neighbours' neighbours until a round changes little; a pair of which
neither edge is new has met before and is not compared again. Every edge at the threshold that is met makes
clusters, listed or not. Where a node's list is full of such edges it may hide others: lists are then doubled
and the search goes on between clusters only, until no list is full of links. An audit of every fiftieth node
against all nodes of its label tells the share of links that lie within one cluster; below the target there
are more trees, and then labels are compared whole. The search works on unit vectors in single precision; in
a cluster, links are counted exactly in double precision, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, apart, components, dealt_in_cells, local_components, per_group, quoted, stash

THRESHOLD = 0.98
#: Neighbours that a list starts with, random trees, rows of a leaf, rounds at most.
NEIGHBOURS, TREES, LEAF, ROUNDS = 12, 12, 96, 6
#: Signs that a tree has at most.
DEEPEST = 40
#: A round that adds fewer new edges than this share of all ends the refinement; the audit's target.
SETTLED, RECALL = 0.002, 0.995
#: An audit takes one node in so many as a query, and may ask so often for more trees.
AUDIT_SHARE, TRIES = 50, 1
#: Nodes of a block; queries and nodes of a cell of the audit.
BLOCK, AUDIT_QUERIES, AUDIT_NODES = 256, 1024, 4096
#: What single precision may take from or add to a cosine.
SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is made one first, so that no square leaves the range of numbers."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_length(v) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the column's vectors of each length."""
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    return [(at := np.flatnonzero(lengths == n), matrix(v.take(pa.array(at)))) for n in np.unique(lengths)]


def with_units(df: DataFrame) -> DataFrame:
    """``u``: the unit vector of ``v`` in single precision."""

    def make():
        def compute(v):
            out: list = [None] * len(v)
            for at, vectors in by_length(v):
                for i, u in zip(at.tolist(), unit(vectors).astype(np.float32), strict=True):
                    out[i] = u
            return [pa.array(out, pa.list_(pa.float32()))]

        return compute

    return append_columns(df, ["v"], [T.StructField("u", T.ArrayType(T.FloatType()))], make)


def valid_nodes(df: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with its node's key, null if it links with nothing; and the distinct vectors of each label."""
    v, own = F.col(quoted(vector)), F.col(quoted(label))
    fine = (
        v.isNotNull() & own.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = df.select(
        F.col(quoted(id_col)).alias("id"), F.monotonically_increasing_id().alias("row"), F.when(fine, own.cast("string")).alias("label"), F.when(fine, v.cast("array<double>")).alias("v")
    )
    # the label's length tells where it ends, so no label and vector look like others
    spelled = F.concat_ws(",", F.length("label").cast("string"), "label", F.col("v").cast("array<string>"))
    rows = stash(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(spelled, 256))), "vectors")
    least = F.min(F.struct("id", "row")).alias("least")
    found = rows.where("key is not null").groupBy("key").agg(least, F.count("*").alias("weight"))
    nodes = found.select("key", F.col("least.row").alias("node"), F.col("least.id").alias("node_id"), "weight")
    # vectors of unlike lengths never meet: the length is a part of the label
    vectors = rows.select(F.col("row").alias("node"), F.concat_ws("/", F.size("v"), "label").alias("label"), "v")
    return rows, stash(with_units(nodes.join(vectors, "node")), "nodes")


def best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node's edges(a, b, sim)."""
    ranked = edges.groupBy("a").agg(F.expr(f"slice(sort_array(collect_set(struct(sim, b)), false), 1, {k})").alias("near"))
    return ranked.select("a", F.explode("near").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))


def nearest_in_group(k: int, threshold: float):
    """Of the nodes in one small group: each open one's ``k`` nearest outside its own cluster, and all links between clusters, as edges with a hub (sim null).

    Pairs of which neither node is new to the group are left out.
    """

    def fn(node, units, cluster, open_, fresh):
        node, first = np.unique(node.to_numpy(zero_copy_only=False), return_index=True)
        own = cluster.to_numpy(zero_copy_only=False)[first]
        if (own == own[0]).all():
            return None
        fresh = fresh.to_numpy(zero_copy_only=False)[first]
        u = matrix(units)[first]
        sim = u @ u.T
        sim[(own[:, None] == own[None, :]) | ~(fresh[:, None] | fresh[None, :])] = -2
        m = min(k, len(node) - 1)
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        a = np.repeat(np.arange(len(node)), m)
        b = top.ravel()
        listed = (sim[a, b] > -2) & open_.to_numpy(zero_copy_only=False)[first][a]
        a, b = a[listed], b[listed]
        linked = sim >= threshold - SLACK
        hub = local_components(linked) if linked.any() else np.arange(len(node))
        some = np.flatnonzero(hub != np.arange(len(node)))
        # rounded, so that a pair that meets twice has one similarity
        near = np.round(sim[a, b].astype(np.float64), 5).tolist()
        return [[*node[a], *node[some]], [*node[b], *node[hub[some]]], [*near, *[None] * len(some)]]

    return fn


#: Large labels up to this number are broadcast (under 20 MB); more are joined by shuffle.
BROADCAST_LABELS = 100_000


def leaves(nodes: DataFrame, first: int, dims: int) -> DataFrame:
    """(node, open, grp) of each node in the leaf of each of ``TREES`` random trees: the signs of projections, within the label.

    A label's own count sets the number of signs, and a leaf that is still large is split by more of them.
    """

    trees, deepest = TREES, DEEPEST

    def make():
        planes = np.random.default_rng(1000 + first).normal(size=(dims, trees * deepest))

        def compute(u):
            codes = np.zeros((len(u), trees), np.int64)
            for at, vectors in by_length(u):
                signs = (vectors @ planes[: vectors.shape[1]] > 0).reshape(len(at), trees, deepest)
                codes[at] = signs @ (np.int64(1) << np.arange(deepest))
            return [pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * trees, pa.array(codes.ravel()))]

        return compute

    field = T.StructField("codes", T.ArrayType(T.LongType()))
    coded = append_columns(nodes.select("node", "label", "open", "u"), ["u"], [field], make, drop=["u"])
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select("label", F.ceil(F.log2(F.col("n") / LEAF)).cast("int").alias("bits"))
    few = sizes.count() <= BROADCAST_LABELS
    each = coded.join(F.broadcast(sizes) if few else apart(sizes, "label"), "label", "left").select("node", "open", "label", F.least(F.coalesce("bits", F.lit(0)), F.lit(DEEPEST)).alias("bits"), F.posexplode("codes").alias("tree", "code"))
    leaf = F.xxhash64("label", F.col("tree") + first, F.expr("code & (shiftleft(1L, bits) - 1)"))
    each = stash(each.select("node", "open", leaf.alias("leaf"), F.expr("shiftright(code, bits)").alias("rest")), "leaves")
    large = each.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * LEAF).select("leaf", F.ceil(F.log2(F.col("n") / LEAF)).cast("int").alias("more"))
    deeper = F.when(F.col("more").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", F.expr("rest & (shiftleft(1L, more) - 1)")))
    return split_groups(each.join(apart(large, "leaf"), "leaf", "left").select("node", "open", F.lit(True).alias("fresh"), deeper.alias("leaf")), "leaf", 4 * LEAF, first)


def split_groups(members: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Groups with an open and a new member; those of more than ``size`` members in random parts of about that size, other ones for each key and seed (the part is mixed into the key)."""
    counts = members.groupBy(key).agg(F.ceil(F.count("*") / size).alias("parts"), F.max("open").alias("some"), F.max("fresh").alias("any")).where("some and any").drop("some", "any")
    return members.join(apart(counts, key), key).withColumn("grp", F.xxhash64(key, F.expr(f"pmod(xxhash64(node, {key}, {seed}), parts)"))).drop("parts", key)


COLUMNS = ["node", "u", "cluster", "open", "fresh"]
MET = "a long, b long, sim double"


def nn_descent(nodes: DataFrame, *, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD, rounds: int = ROUNDS, report: Callable[[int, float], None] | None = None) -> DataFrame:
    """Clusters (node, cluster) of ``nodes(node, label, u)`` that the links found make, without single nodes.

    The audit has the last word: below the target there are more trees, then the labels below it, and at
    last all labels, are compared whole. ``report`` is told the number of links that each audit looked at and
    the share of them found.
    """
    dims = nodes.agg(F.max(F.size("u"))).first()[0]
    if dims is None:
        return nodes.sparkSession.createDataFrame([], "node long, cluster long")
    spread = nodes.withColumns({"cluster": F.col("node"), "open": F.lit(True)})
    k, known, links, first, tries = neighbours, None, None, 0, 0
    while True:
        graph, found = refine(spread, known, k, threshold, rounds, dims, first)
        first += TREES
        links = found if links is None else stash(links.unionByName(found), "near")
        cluster = components(links, "vectors").select("node", F.col("component").alias("cluster"))
        # full lists of links alone may hide more: they are enlarged, and what they have is not listed again
        full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("last")).where((F.col("n") >= k) & (F.col("last") >= threshold - SLACK))
        open_ = full.select(F.col("a").alias("node"), F.lit(True).alias("open"))
        if full.isEmpty():
            below = audit(nodes, cluster, threshold, first, report)
            if below is None:
                return cluster
            if tries == TRIES:
                break
            tries, open_ = tries + 1, nodes.select("node", F.lit(True).alias("open"))
        else:
            k *= 2
        known = graph if known is None else stash(known.unionByName(graph), "known")
        spread = stash(clustered(nodes, cluster).join(open_, "node", "left").withColumn("open", F.coalesce("open", F.lit(False))), "spread")
    for chosen in (nodes.join(below, "label", "left_semi"), nodes):
        links = stash(links.unionByName(compared(clustered(chosen, cluster), threshold)), "near")
        cluster = components(links, "vectors").select("node", F.col("component").alias("cluster"))
        first += 1
        if chosen is nodes or audit(nodes, cluster, threshold, first, report) is None:
            return cluster


def clustered(nodes: DataFrame, cluster: DataFrame) -> DataFrame:
    return nodes.join(cluster, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))


def compared(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges that join all clusters of a label with a link between them: every pair is compared, in cells of bounded size."""
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    whole = nodes.withColumns({"open": F.lit(True), "fresh": F.lit(True)}).join(apart(sizes, "label"), "label")
    cells = dealt_in_cells(whole, "label", "node", "blocks")
    return per_group(cells, "cell", COLUMNS, MET, nearest_in_group(1, threshold)).where("sim is null").select("a", "b").distinct()


def refine(nodes: DataFrame, known: DataFrame | None, k: int, threshold: float, rounds: int, dims: int, first: int) -> tuple[DataFrame, DataFrame]:
    """(lists, links): each open node's ``k`` nearest outside its cluster, and edges that join all clusters of which a link was met.

    Lists of ``known`` are walked along with the new ones; groups without an open and a new node are left alone.
    """
    vectors = nodes.select("node", "u", "cluster")
    meet = lambda groups: stash(per_group(groups.join(vectors, "node"), "grp", COLUMNS, MET, nearest_in_group(k, threshold)), "met")
    met = meet(leaves(nodes, first, dims))
    links = met.where("sim is null").select("a", "b").distinct()
    graph = stash(best(met.where("sim is not null"), k).withColumn("fresh", F.lit(True)), "graph")
    flags = nodes.select("node", "open")
    for n in range(rounds):
        # each node's list, both ways: a node's neighbours meet in its group, where one of the two edges is new
        walked = graph if known is None else graph.unionByName(known.select("a", "b", "sim", F.lit(False).alias("fresh")))
        ends = F.explode(F.array(F.struct("a", F.col("b").alias("node")), F.struct(F.col("b").alias("a"), F.col("a").alias("node")))).alias("e")
        both = walked.select(ends, "fresh").groupBy("e.a", "e.node").agg(F.max("fresh").alias("fresh"))
        met = meet(split_groups(both.join(flags, "node"), "a", 8 * k, first + n + 1))
        links = stash(links.unionByName(met.where("sim is null").select("a", "b")).distinct(), "near")
        old = graph.select("a", "b", F.lit(False).alias("fresh"))
        new = stash(best(graph.drop("fresh").unionByName(met.where("sim is not null")), k).join(old, ["a", "b"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(True))), "graph")
        sums = new.agg(F.count_if("fresh").alias("added"), F.count("*").alias("total")).first()
        graph = new
        if sums.added <= SETTLED * max(1, sums.total):
            break
    return graph.drop("fresh"), links


def audited_in_cell(threshold: float):
    """The links between queries and nodes of one cell, and those of them with both ends in one cluster."""

    def fn(node, units, cluster, query, label):
        query = query.to_numpy(zero_copy_only=False)
        if not query.any():
            return None
        node, cluster, u = node.to_numpy(zero_copy_only=False), cluster.to_numpy(zero_copy_only=False), matrix(units)
        linked = (u[query] @ u[~query].T >= threshold + SLACK) & (node[query][:, None] != node[~query][None, :])
        together = cluster[query][:, None] == cluster[~query][None, :]
        return [[label[0].as_py()], [int(linked.sum())], [int((linked & together).sum())]]

    return fn


def audit(nodes: DataFrame, cluster: DataFrame, threshold: float, seed: int, report=None) -> DataFrame | None:
    """None if the clusters hold enough of the links that brute force finds; else the labels (label) that miss the target.

    Queries are the nodes whose hash is divisible by ``AUDIT_SHARE``, and each meets all nodes of its label, in
    cells of bounded size. Links within single precision of the threshold are not judged.
    """
    share, queries, most = AUDIT_SHARE, AUDIT_QUERIES, AUDIT_NODES
    all_ = clustered(nodes.select("node", "label", "u"), cluster).withColumn("asks", F.expr(f"pmod(xxhash64(node, {seed}), {share}) = 0"))
    sizes = all_.groupBy("label").agg(F.ceil(F.count_if("asks") / queries).alias("across"), F.ceil(F.count("*") / most).alias("down")).where("across > 0")
    dealt = all_.join(apart(sizes, "label"), "label")
    own = lambda n: F.expr(f"pmod(xxhash64(node, {seed + 1}), {n})")
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = dealt.where("asks").select("*", own("across").alias("x"), steps("down").alias("y"), F.lit(True).alias("query"))
    answer = dealt.select("*", steps("across").alias("x"), own("down").alias("y"), F.lit(False).alias("query"))
    cells = asked.unionByName(answer).withColumn("cell", F.xxhash64("label", "x", "y"))
    counted = per_group(cells, "cell", ["node", "u", "cluster", "query", "label"], "label string, n long, got long", audited_in_cell(threshold))
    by_label = stash(counted.groupBy("label").agg(F.sum("n").alias("n"), F.sum("got").alias("got")), "audit")
    whole = by_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("got"), F.lit(0)).alias("got")).first()
    if report:
        report(whole.n, whole.got / max(1, whole.n) if whole.n else 1.0)
    return None if whole.got >= RECALL * whole.n else by_label.where(F.col("got") < RECALL * F.col("n")).select("label")


def linked_in_cell(threshold: float):
    """Exact cosines in one cell of a cluster: for each node its links, weighted by copies, and a hub it is linked with over links."""

    def fn(node, weight, vectors, side, crossed):
        node, first = np.unique(node.to_numpy(zero_copy_only=False), return_index=True)
        if len(node) < 2:
            return None
        u = unit(matrix(vectors)[first].astype(np.float64))
        side, crossed = side.to_numpy(zero_copy_only=False)[first], crossed.to_numpy(zero_copy_only=False)[first]
        linked = u @ u.T >= threshold
        if crossed.any():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        links = linked @ weight.to_numpy(zero_copy_only=False)[first]
        label = local_components(linked)
        some = np.flatnonzero(links)
        return [node[some], links[some], node[label[some]]] if len(some) else None

    return fn


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", *, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, report=None) -> DataFrame:
    """One row for each row of ``df``: (id, n_links, component_id, kept).

    Rows are linked when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``threshold``; vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of unlike lengths. ``n_links`` counts the other rows linked
    directly, equal vectors included; ``component_id`` is the smallest id reachable by links; ``kept`` holds
    where the id is the component's. Rows repeated with their id are linked with each other. Other columns
    are not read; an empty table gives an empty result. ``report`` is told what the audits measure.
    """
    rows, nodes = valid_nodes(df, id_col, vector, label)
    cluster = nn_descent(nodes.select("node", "label", "u"), neighbours=neighbours, threshold=threshold, report=report)
    members = nodes.select("node", "weight", "v").join(cluster, "node")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cells = dealt_in_cells(members.join(apart(sizes, "cluster"), "cluster"), "cluster", "node", "blocks")
    found = stash(per_group(cells, "cell", ["node", "weight", "v", "side", "crossed"], "node long, links long, hub long", linked_in_cell(threshold)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")
    whole = nodes.drop("v", "u", "label").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = stash(whole.select("key", "node_id", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "whole")
    heads = whole.groupBy("component").agg(F.min("node_id").alias("component_id"))
    whole = whole.join(apart(heads, "component"), "component").select("key", "n_links", "component_id")
    out = rows.select("id", "key").join(whole, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id").eqNullSafe(component)).alias("kept"),
    )


def op3_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings; one row per vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
number AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c LEFT JOIN number USING (vec_id)
"""
