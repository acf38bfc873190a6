"""Duplicate clusters that grow: new links against stored labels, without a pass over what is stored (OP-D6 over time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.operators.stores import BUCKETS, Buckets, numbers
from procurelake.shared import components, stash


class GrowingClusters:
    """Connected components of all links that were added, each named by its smallest node.

    A node keeps the label that it got when it came first. Where later links join clusters, the larger labels
    are forwarded to the smallest, in a table by label; forwards are followed from label to label. A batch
    reads the buckets of its own nodes and of the labels on their way, and appends; nothing is rewritten
    until ``compress`` shortens the ways to one step. A batch that is added again adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", buckets: int = BUCKETS):
        of = lambda ddl: T._parse_datatype_string(ddl.format(kind=kind))
        self.buckets = buckets
        self.labels = Buckets(spark, f"{path.rstrip('/')}/labels", of("node {kind}, label {kind}"), buckets)
        self.forwards = Buckets(spark, f"{path.rstrip('/')}/forwards", of("label {kind}, target {kind}"), buckets)

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def followed(self, labels: DataFrame, whole: bool = False) -> DataFrame:
        """(label, root) of distinct ``labels``: where their forwards end. The number of rounds is that of the longest way's steps."""
        now = stash(labels.select("label", F.col("label").alias("root")).distinct(), "roots")
        while True:
            ends = now.select(F.col("root").alias("label")).distinct().withColumn("bucket", self.bucket("label"))
            step = self.forwards.read(None if whole else numbers(ends)).groupBy("label").agg(F.min("target").alias("target"))
            moved = stash(now.join(step.select(F.col("label").alias("root"), "target"), "root", "left"), "roots")
            if moved.where("target is not null").isEmpty():
                return now
            now = moved.select("label", F.coalesce("target", "root").alias("root"))

    def add(self, links: DataFrame) -> None:
        """Add the links ``(a, b)``; nulls are no nodes, a link of a node with itself adds the node."""
        clean = stash(links.where("a is not null and b is not null").select("a", "b").distinct(), "links")
        nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("bucket", self.bucket("node"))
        held = self.labels.read(numbers(nodes)).join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min("label").alias("label"))
        known = stash(nodes.join(held, "node", "left").select("node", "bucket", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("fresh")), "known")
        roots = self.followed(known.select("label"))
        at = stash(known.join(roots, "label").select("node", "root"), "at")
        ends = clean.join(at.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "joined")
        ways = joined.where("node != component").select(F.col("node").alias("label"), F.col("component").alias("target"))
        # labels of new nodes come first: without the forwards they are clusters of their own, and adding the batch again mends that
        self.labels.append(known.where("fresh").select("node", "label", "bucket"))
        self.forwards.append(stash(ways.withColumn("bucket", self.bucket("label")), "ways"))

    def clusters(self) -> DataFrame:
        """(node, cluster) of every node."""
        held = self.labels.read().groupBy("node").agg(F.min("label").alias("label"))
        return held.join(self.followed(held.select("label"), whole=True), "label").select("node", F.col("root").alias("cluster"))

    def compress(self) -> None:
        """Rewrite the forwards so that each leads to its end in one step."""
        ends = self.followed(self.forwards.read().select("label"), whole=True).select("label", F.col("root").alias("target"))
        self.forwards.replace(stash(ends.withColumn("bucket", self.bucket("label")), "ways"))
