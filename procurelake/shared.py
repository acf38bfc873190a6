"""Tables in the folder that all executors see, and connected components on them."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a session of one process may leave it unnamed (tests); it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="procurelake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that were stashed in each open scope, the innermost last.
SCOPES: list[list[str]] = []


@contextlib.contextmanager
def stashes_removed(spark: SparkSession) -> Iterator[None]:
    """A scope whose stashed tables are removed when it ends; results that are made of them have to be written within it."""
    SCOPES.append([])
    try:
        yield
    finally:
        for path in SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, so a lost executor costs one stage.

    The table stays until the innermost scope of ``stashes_removed`` ends, if there is one.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    if SCOPES:
        SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df``, with one row a key, dealt out on its own before a join on ``key``.

    A grouped table that is joined back as it was grouped ties the other side to the same tasks; dealt out
    anew, both sides are plain shuffles, of which Spark splits those that a hot key makes large.
    """
    return df.repartition(F.xxhash64(key, F.lit(1)))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns (node, component): every node that occurs in an edge, with the smallest node reachable from it.
    Each step is a grouped minimum (combined before the shuffle) and a join back that can be split, so a hub
    with a third of all edges is never one task's group. Rounds end when the edges are stars (every node has one parent and
    no parent has one), of which the driver sees two numbers; edges that are not settled after ``max_rounds``
    (their number falls with the logarithm of the longest path) are an error. Self-loops and nulls are ignored;
    an empty edge table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")

    def settled(df: DataFrame) -> bool:
        roles = df.select(F.explode(F.array(F.struct(a.alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(b.alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("r"))
        by_node = roles.groupBy("r.x").agg(F.sum("r.up").alias("up"), F.max("r.down").alias("down"))
        return by_node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()

    clean = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = stash(clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    for done in itertools.count():
        if settled(now):
            break
        if done == max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node points to the smallest node around it
        large = both.where(b > a).join(apart(low, "a"), "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, points to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low, "a"), "a").select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stash(small.select("e.a", "e.b").where(a != b).distinct(), name)
    roots = now.select(b.alias("node"), b.alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).unionByName(roots)
