"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

A text is the set of its five-word shingles; texts with equal sets are one class from the start. Each class
has a path of minimum hashes in every tree of the forest, and a tree is the trie of these paths, stored in
their order, so that a node of the trie is a run of rows. Classes that share a long prefix are linked into
clusters first. Then the prefixes are shortened, a few places at a time, and nodes of the trie that touch
several clusters are looked at: signatures are compared, and those alike enough join their clusters. This
goes on until a pair right at the threshold is met with the target recall and an audit, which compares some
texts exactly with all others, finds its links within clusters. Last, all classes of a cluster are verified
exactly against each other, in cells of bounded size, which count links and give a spanning set of them;
pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, apart, components, dealt_in_cells, local_components, per_group, quoted, stash, text_or_empty, unused
from procurelake.llm.words import WordTable, shingles

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, places of a path, places by which prefixes are shortened, and the chance to meet a pair at the threshold.
TREES, DEEPEST, SHORTER, RECALL = 24, 8, 2, 0.99999
#: Signatures alike in this share of places may belong to texts of the threshold; seven standard deviations below it.
MARGIN = 0.2
#: Members of a block, and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: An audit asks with one text in fifty, about this many at most, and has so many shingles in all (3 MB to broadcast);
#: of a text so many links are looked at. The share of links to find. What an audit can tell depends on the number
#: of its links and not on their share of all, so it is as good for larger tables.
AUDIT_SHARE, AUDIT_TEXTS, AUDIT_SHINGLES, AUDIT_LINKS, FOUND = 50, 1_000, 250_000, 8, 0.999


def chance_to_meet(depth: int, trees: int, threshold: float) -> float:
    """That a pair at the threshold shares a prefix of ``depth`` places in one of the trees at least."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold shares a bucket with the target recall: shortened step by step."""
    depth = deepest
    while depth > 1 and chance_to_meet(depth, trees, threshold) < recall:
        depth -= 1
    return depth


class Questions:
    """The shingle sets that an audit asks with, turned round: shingle -> the sets that have it."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.owners = np.repeat(np.arange(len(sets)), self.size)[order]
        self.threshold = threshold

    def linked(self, found: np.ndarray) -> list[int]:
        """The sets whose Jaccard similarity with ``found`` reaches the threshold, the first few of them."""
        if not len(self.keys) or not len(found):
            return []
        # a set that is similar enough has one at least of so many shingles, whichever they are
        some = found[: len(found) - ceil(self.threshold * len(found) - 1e-9) + 1]
        if not (self.keys[np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)] == some).any():
            return []
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at = at[self.keys[at] == found]
        n = self.ends[at + 1] - self.ends[at]
        places = np.repeat(self.ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owners[places], minlength=len(self.size))
        return np.flatnonzero(both / (self.size + len(found) - both) >= self.threshold)[:AUDIT_LINKS].tolist()


class Minima:
    """Minimum hashes under as many permutations of 32-bit values as the forest has levels."""

    def __init__(self, number: int, seed: int = 20_240_229):
        random = np.random.default_rng(seed)
        self.flip = random.integers(0, 1 << 32, number, dtype=np.uint32)[:, None]
        self.times = (random.integers(0, 1 << 31, number, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

    def of(self, hashes: np.ndarray) -> bytes:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(low), 2048):
            some = np.bitwise_xor(self.flip, low[None, lo : lo + 2048])
            some *= self.times
            np.minimum(best, some.min(1), out=best)
        return best.astype("<u2").tobytes()


def shingler(size: int):
    table = WordTable(xxhash.xxh3_64_intdigest)
    return lambda text: shingles(table.of(text.lower().split()), size)


def with_sets(df: DataFrame, text: str, size: int, *, signature: int = 0, sets: bool = False, questions: Questions | None = None) -> DataFrame:
    """Replace the text by ``digest`` of its shingle set (null without words), ``n`` of its shingles, and on demand the signature, the set or the questions it answers."""
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())]
    fields += [T.StructField("signature", T.BinaryType())] * bool(signature) + [T.StructField("shingles", T.BinaryType())] * sets
    kinds = [pa.binary(), pa.int64(), *[pa.binary()] * (bool(signature) + sets)]
    if questions:
        fields.append(T.StructField("answers", T.ArrayType(T.LongType())))
        kinds.append(pa.list_(pa.int64()))
    asked = df.sparkSession.sparkContext.broadcast(questions) if questions else None

    def make():
        cut, minima = shingler(size), Minima(signature) if signature else None

        def compute(texts: pa.Array):
            out: list[list] = [[] for _ in fields]
            for t in texts:
                found = cut(t.as_py() or "")
                raw = found.tobytes()
                row = [xxhash.xxh3_128_digest(raw) if len(found) else None, len(found)]
                if minima:
                    row.append(minima.of(found) if len(found) else None)
                if sets:
                    row.append(raw)
                if asked:
                    row.append(asked.value.linked(found))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]

        return compute

    return append_columns(df, [text_or_empty(text)], fields, make, drop=[text])


def audit_questions(df: DataFrame, size: int, threshold: float) -> tuple[Questions, list[bytes]]:
    """(questions, digests) of some of the ``text`` of ``df``, chosen by their hash; bounded in number and in shingles."""
    parts = max(AUDIT_SHARE, df.count() // AUDIT_TEXTS)
    hashed = df.select(F.xxhash64("text").alias("hash"), "text").where(F.pmod("hash", F.lit(parts)) == 0)
    once = hashed.groupBy("hash").agg(F.any_value("text").alias("text"))
    sets, digests, total = [], [], 0
    for r in with_sets(once, "text", size, sets=True).where("digest is not null").toLocalIterator():
        total += r.n
        if total > AUDIT_SHINGLES:
            break
        sets.append(np.frombuffer(r.shingles, np.uint64))
        digests.append(bytes(r.digest))
    return Questions(sets, threshold), digests


def alike_in_cell(cut: float):
    """Edges between the clusters of members whose signatures are alike, in one cell of a bucket."""

    def fn(member, cluster, signature, crossed):
        member = member.to_numpy(zero_copy_only=False)
        if len(member) < 2:
            return None
        sig = np.frombuffer(b"".join(signature.to_pylist()), "<u2").reshape(len(member), -1)
        same = np.zeros((len(member), len(member)), np.uint16)
        for k in range(sig.shape[1]):
            same += sig[:, k, None] == sig[None, :, k]
        name = cluster.to_numpy(zero_copy_only=False)
        alike = (same >= cut * sig.shape[1]) & (name[:, None] != name[None, :])
        label = local_components(alike)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return [name[moved], name[label[moved]]] if len(moved) else None

    return fn


def verified_in_cell(threshold: float):
    """Exact Jaccard in one cell of a cluster: for each member its links, weighted by class size, and a hub it is linked with over links."""

    def fn(member, weight, sets, side, crossed):
        member, first = np.unique(member.to_numpy(zero_copy_only=False), return_index=True)
        n = len(member)
        if n < 2:
            return None
        raw = [np.frombuffer(sets[i].as_py(), np.uint64) for i in first.tolist()]
        weight = weight.to_numpy(zero_copy_only=False)[first]
        side, crossed = side.to_numpy(zero_copy_only=False)[first], crossed.to_numpy(zero_copy_only=False)[first]
        length = np.array([len(x) for x in raw])
        owner = np.repeat(np.arange(n), length)
        _, place, count = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        shared = count[place] > 1
        column = (np.cumsum(count > 1) - 1)[place[shared]]
        owner, width = owner[shared], int((count > 1).sum())
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for lo in range(0, width, 4096):
            a, b = np.searchsorted(column, (lo, lo + 4096))
            dense = np.zeros((n, min(4096, width - lo)), np.float32)
            dense[owner[a:b], column[a:b] - lo] = 1
            both += dense @ dense.T
        union = length[:, None] + length[None, :] - both.astype(np.float64)
        linked = both / union >= threshold
        # counted here: pairs of unlike sides where two blocks meet, all pairs where a block meets itself
        linked &= (side[:, None] != side[None, :]) if crossed.any() else ~np.eye(n, dtype=bool)
        np.fill_diagonal(linked, False)
        links = linked @ weight
        label = local_components(linked)
        some = np.flatnonzero(links)
        return [member[some], links[some], member[label[some]]] if len(some) else None

    return fn


def in_nodes(forest: DataFrame, depth: int) -> DataFrame:
    """``forest`` with the trie node at ``depth`` that each path goes through."""
    return forest.withColumn("bucket", F.xxhash64("tree", F.expr(f"substring(path, 1, {2 * depth})")))


def forest_of(signed: DataFrame, trees: int, deepest: int, depth: int) -> DataFrame:
    """The tries (member, tree, path) in order of their paths, without the paths that share no prefix of ``depth`` places."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    paths = signed.select("member", "signature", tree).select("member", "tree", F.expr(f"substring(signature, tree * {2 * deepest} + 1, {2 * deepest})").alias("path"))
    every = in_nodes(paths, depth)
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = every.join(apart(shared, "bucket"), "bucket").drop("bucket")
    # the member comes last, so that a path that very many share is split too
    return stash(met.repartitionByRange("tree", "path", "member").sortWithinPartitions("tree", "path", "member"), "forest")


def joined_clusters(forest: DataFrame, signed: DataFrame, cluster: DataFrame, depth: int, alike: float, whole: bool) -> DataFrame:
    """Edges between clusters that trie nodes at ``depth`` touch and whose members' signatures are alike.

    One member speaks for its cluster in a node, unless the ``whole`` node is to be compared.
    """
    named = in_nodes(forest, depth).join(cluster.select(F.col("node").alias("member"), "component"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    if not whole:
        named = named.groupBy("bucket", "component").agg(F.min("member").alias("member"))
    several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    met = named.select("bucket", "component", "member").join(apart(several.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "bucket"), "bucket")
    cells = dealt_in_cells(met, "bucket", "member", "blocks").join(signed, "member")
    return per_group(cells, "cell", ["member", "component", "signature", "crossed"], "a long, b long", alike_in_cell(alike))


def candidate_clusters(
    signed: DataFrame, links: DataFrame, *, trees: int, deepest: int, threshold: float, recall: float, report: Callable[[int, int, float], None] | None = None
) -> DataFrame:
    """Clusters (node, component) of ``signed(member, signature)``, within which all links lie.

    Prefixes are shortened until the chance to meet a pair at the threshold reaches ``recall`` and the share of
    the audit's ``links`` (a, b) within clusters reaches FOUND; ``report`` is told each depth, the number of links and that share.
    """
    floor = prefix_depth(trees, deepest, threshold, recall)
    forest = forest_of(signed, trees, deepest, floor)
    deep = in_nodes(forest, deepest)
    first = deep.groupBy("bucket").agg(F.min("member").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    edges = deep.join(apart(first, "bucket"), "bucket").where("member != hub").select(F.col("member").alias("a"), F.col("hub").alias("b")).distinct()
    cluster, depth = components(edges, "clusters"), deepest
    while True:
        share = 1.0
        if depth <= floor:
            ends = links.join(cluster.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(cluster.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
            sums = ends.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("got")).first()
            share = sums.got / sums.n if sums.n else 1.0
            if report:
                report(depth, sums.n, share)
            if share >= FOUND or depth == 1:
                return cluster
            forest = forest_of(signed, trees, deepest, depth - 1)
        depth = depth - 1 if depth <= floor else max(floor, depth - SHORTER)
        more = joined_clusters(forest, signed, cluster, depth, threshold - MARGIN, depth <= floor)
        # the new edges join clusters: their components relabel them
        moved = components(more, "clusters").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        old = cluster.join(apart(moved, "component"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        fresh = moved.join(cluster.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
        cluster = stash(old.unionByName(fresh), "clusters")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", *, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, report=None
) -> DataFrame:
    """One row for each row of ``df``: (id, class_id, n_links, set_id, kept).

    Two rows are linked when the Jaccard similarity of their sets of ``size``-word shingles (words: runs
    between white space, lower-cased; a text of fewer words is one shingle) is at least ``threshold``.
    ``n_links`` counts the other rows linked directly, copies included; ``class_id`` is the smallest id
    reachable by links, ``set_id`` the smallest id with the same shingle set; one row of a class is kept,
    that of its smallest id. Texts without words, null and empty ones among them, link with nothing and
    are kept. Rows repeated with their id are linked with each other, and one stays. A null id ranks
    lowest. Other columns are not read, whatever their names; long texts are read whole; an empty table
    gives an empty result. ``report`` is told what the audits measure.
    """
    base = df.select(F.col(quoted(id_col)).alias("id"), text_or_empty(text).alias("text"))
    if not base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # ids that repeat, null ones too, do not tell texts apart: the row's number is added to them
        numbered = stash(base.select(F.struct("id", F.monotonically_increasing_id().alias("number")).alias("key"), "text"), "numbered")
        found = near_duplicates(numbered, "key", "text", size=size, threshold=threshold, trees=trees, deepest=deepest, recall=recall, report=report)
        return found.select(F.col("key.id").alias(id_col), F.col("class_id.id").alias("class_id"), "n_links", F.col("set_id.id").alias("set_id"), "kept")
    questions, digests = audit_questions(base.select("text"), size, threshold)
    signed = with_sets(base.withColumn("row", F.monotonically_increasing_id()), "text", size, signature=trees * deepest, questions=questions)
    rows = stash(signed, "signed")
    least = F.min(F.struct("id", "row")).alias("least")
    classes = stash(
        rows.where("digest is not null").groupBy("digest").agg(least, F.count("*").alias("weight")).select("digest", F.col("least.row").alias("member"), F.col("least.id").alias("set_id"), "weight"),
        "classes",
    )
    signed = stash(rows.select(F.col("row").alias("member"), "signature").join(classes.select("member"), "member", "left_semi"), "members")
    # the audit's links between classes
    asked = df.sparkSession.createDataFrame(list(enumerate(digests)), "question long, asked binary")
    answers = rows.where("size(answers) > 0").select("digest", F.explode("answers").alias("question")).distinct().join(F.broadcast(asked), "question").where("digest != asked")
    known = classes.select("digest", "member")
    links = answers.join(known.withColumnRenamed("member", "a"), "digest").drop("digest").join(known.select(F.col("digest").alias("asked"), F.col("member").alias("b")), "asked")
    links = stash(links.select("a", "b"), "audit")
    cluster = candidate_clusters(signed, links, trees=trees, deepest=deepest, threshold=threshold, recall=recall, report=report)

    # exact verification within the clusters
    chosen = cluster.select(F.col("node").alias("member"), F.col("component").alias("cluster")).join(classes.select("member", "set_id", "weight", F.col("digest").alias("known")), "member")
    chosen = chosen.join(rows.select(F.col("row").alias("member"), "n"), "member")
    sizes = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    chosen = chosen.drop("n").join(apart(sizes, "cluster"), "cluster")
    texts = base.join(chosen, base["id"].eqNullSafe(chosen["set_id"]))
    sets = with_sets(texts.select("text", "member", "cluster", "weight", "known", "blocks"), "text", size, sets=True).where("digest = known")
    cells = dealt_in_cells(sets.drop("digest", "known", "n"), "cluster", "member", "blocks")
    found = stash(
        per_group(cells, "cell", ["member", "weight", "shingles", "side", "crossed"], "member long, links long, hub long", verified_in_cell(threshold)), "links"
    )
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("member").alias("a"), F.col("hub").alias("b")), "links")
    whole = classes.join(links, "member", "left").join(joined.withColumnRenamed("node", "member"), "member", "left")
    whole = stash(
        whole.select("digest", "member", "set_id", F.coalesce("component", "member").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "whole"
    )
    # classes of one row and no link need no look-up
    linked = whole.where("n_links > 0")
    heads = linked.groupBy("component").agg(F.min(F.struct(F.col("set_id").alias("id"), F.col("member").alias("row"))).alias("head"))
    linked = stash(linked.join(apart(heads, "component"), "component").select("digest", "set_id", "n_links", F.col("head.id").alias("class_id"), F.col("head.row").alias("head_row")), "linked")
    out = rows.select("id", "row", "digest").join(linked, "digest", "left")
    alone = F.col("head_row").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("set_id")).alias("set_id"),
        (alone | (F.col("row") == F.col("head_row"))).alias("kept"),
    )


def keep_one_of_each_class(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those that ``near_duplicates`` does not keep; rows are told apart by number, so ids may be null or repeated."""
    name = unused(df, "row")
    numbered = stash(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    # the number stands beside the id, which still decides who stays
    key = F.struct(F.col(quoted(id_col)).alias("id"), F.col(name).alias("row"))
    gone = near_duplicates(numbered.select(key.alias("key"), F.col(quoted(text)).alias("text")), "key", "text").where("not kept").select(F.col("key.row").alias(name))
    return numbered.join(gone, name, "left_anti").select(*[F.col(quoted(c)) for c in df.columns])


def op2_near_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents; one row per document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM words WHERE len(w) > 0),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
size AS (SELECT doc_id, len(s) AS n FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y, c / (p.n + q.n - c) AS j FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE c / (p.n + q.n - c) >= 0.8),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1),
number AS (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (WHERE j = 1) AS twin FROM links GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, least(d.doc_id, coalesce(twin, d.doc_id)) AS set_id, class_id = d.doc_id AS kept
FROM documents d JOIN class USING (doc_id) LEFT JOIN number USING (doc_id)
"""
