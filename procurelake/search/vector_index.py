"""Vector search over k-means lists: a query reads the lists nearest to it, or all of them (OP-X12, OP-F15).

Centroids come from Spark's k-means on a bounded sample of unit vectors (SAMPLE, by a hash of the id); every
vector is in a list. Lists are partitions of the stored table, cut into blocks of bounded size. Queries are a
table: each is sent to its nearest lists, lists that no query asks for are not read, cosines are computed in
double precision in each block, and the best of each block are ranked together. How many lists a query reads is
chosen when the index is built: an audit asks for the nearest of some vectors exactly and takes the fewest lists that
hold the target share of them. Where vectors have no clusters these are most lists. With all lists asked the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.shared import stash

#: Lists; vectors that the centroids are fitted on, about; rows of a block, on average.
LISTS, SAMPLE, BLOCK = 64, 50_000, 4096
#: Queries that are compared with a block at once, about; similarities that are held at once.
ASKED, TILE = 16_384, 1 << 20
#: Vectors that the audit asks with, about, and neighbours of each; the share of them to find; the number of lists that it chose.
AUDIT, NEIGHBOURS, FOUND, CHOSEN = 400, 20, 0.95, 0


def usable(column: str):
    """Vectors with a direction: not null, not zero, all components finite."""
    c = F.col(column)
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class VectorLists:
    """An index of ``rows(key, embedding)`` written at ``path``. All vectors have one length; those without a direction are in no list and in no result."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def build(self, rows: DataFrame, embedding: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, seed: int = 1) -> VectorLists:
        """Fit the centroids, write the lists. Repeated rows are indexed each; an empty table has no lists."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        own = rows.where(usable(embedding)).select(self.key, F.col(embedding).cast("array<double>").alias("v"))
        n = own.count()
        some = own if n <= sample else own.where(F.pmod(F.xxhash64(self.key, F.lit(3)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        units = some.withColumn("length", length).where("length > 0").select(array_to_vector(F.transform("v", lambda x: x / F.col("length"))).alias("features"))
        centroids = [c.tolist() for c in KMeans(k=max(2, min(lists, n)), seed=seed, maxIter=12).fit(units).clusterCenters()] if n > 2 else []
        self.spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{self.path}/centroids")
        placed = stash(self.nearest(own, 1).select(self.key, "v", F.col("lists")[0].alias("list")), "placed")
        # at most as many sizes as lists
        blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        cut = placed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64(self.key), F.col("blocks")))
        cut.drop("blocks").repartition("list", "block").write.partitionBy("list").parquet(f"{self.path}/rows")
        blocks.write.parquet(f"{self.path}/sizes")
        own.select(self.key, "v").limit(0).write.parquet(f"{self.path}/schema")
        some = own.where(F.pmod(F.xxhash64(self.key, F.lit(5)), F.lit(max(1, n // AUDIT))) == 0).select(F.col(self.key).alias("query"), "v")
        near = self.search(some, NEIGHBOURS + 1, None, embedding="v").where("query != key").select("query", "key")
        met = near.join(placed.select(F.col(self.key).alias("key"), "list"), "key").join(self.nearest(some, len(centroids) or 1).select("query", F.posexplode("lists").alias("at", "list")), ["query", "list"])
        counts = {r["at"]: r["count"] for r in met.groupBy("at").count().collect()}  # one row for each list at most
        held, probes = 0, 0
        while probes < len(centroids) and held < FOUND * sum(counts.values()):
            held, probes = held + counts.get(probes, 0), probes + 1
        self.spark.createDataFrame([(max(1, probes), held / max(1, sum(counts.values())))], "probes int, recall double").write.parquet(f"{self.path}/audit")
        return self

    def audit(self) -> tuple[int, float]:
        """(lists that a query reads, share of the audit's neighbours that these hold)."""
        r = self.spark.read.parquet(f"{self.path}/audit").first()
        return r.probes, r.recall

    def nearest(self, vectors: DataFrame, probes: int) -> DataFrame:
        """``vectors(..., v)`` with the numbers of the ``probes`` nearest lists, nearest first; list 0 where there are no centroids."""
        found = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        centroids = self.spark.sparkContext.broadcast(unit(np.array([r.centroid for r in found])) if found else None)
        place = vectors.columns.index("v")
        schema = T.StructType([*vectors.schema.fields, T.StructField("lists", T.ArrayType(T.LongType()))])

        def run(batches):
            c = centroids.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = np.zeros((batch.num_rows, 1), np.int64) if c is None else np.argsort(-(unit(matrix(batch.column(place))) @ c.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], names=schema.names)

        return vectors.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = CHOSEN, query: str = "query", embedding: str = "embedding") -> DataFrame:
        """(query, key, similarity, rank): the ``k`` most similar rows of each of ``queries(query, embedding)``; ties by key.

        Only the ``probes`` nearest lists are searched, as many as the audit chose by default, or all of them, exactly, if it is None. Queries without
        a direction find nothing; equal queries under different names are answered each.
        """
        asked = queries.where(usable(embedding)).select(F.col(query).alias("query"), F.col(embedding).cast("array<double>").alias("v"))
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        probes = self.audit()[0] if probes == CHOSEN else probes
        # lists are long on both sides of the comparison: an int of the same value would be dealt to another task
        if probes is None:
            sent = asked.crossJoin(F.broadcast(sizes))
        else:
            sent = self.nearest(asked, probes).select("query", "v", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
        parts = max(1, -(-asked.count() // ASKED))
        part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")
        sent = stash(sent.select("query", "v", F.col("list").cast("long").alias("list"), part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "asked")
        lists = sorted(r.list for r in sent.select("list").distinct().collect())
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("block", T.LongType()).add("list", T.IntegerType())
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("list").isin(lists)).select(F.col(self.key).alias("key"), "v", F.col("list").cast("long").alias("list"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        kind = rows.schema["key"].dataType.simpleString()

        def compare(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({"query": left["query"].slice(0, 0), "key": right["key"].slice(0, 0), "similarity": pa.array([], pa.float64())})
            right = right.sort_by("key")
            r = unit(matrix(right["v"]))
            at, to, value = [], [], []
            tile = max(1, TILE // len(r))
            for lo in range(0, left.num_rows, tile):
                sims = np.round(unit(matrix(left["v"].slice(lo, tile))) @ r.T, 12)
                # a stable sort keeps ties in order of the key
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                at.append(np.repeat(np.arange(len(sims)) + lo, top.shape[1]))
                to.append(top.ravel())
                value.append(np.take_along_axis(sims, top, 1).ravel())
            return pa.table({"query": left["query"].take(pa.array(np.concatenate(at))), "key": right["key"].take(pa.array(np.concatenate(to))), "similarity": pa.array(np.concatenate(value))})

        schema = f"query {asked.schema['query'].dataType.simpleString()}, key {kind}, similarity double"
        best = sent.groupBy("list", "block", "part").cogroup(rows.groupBy("list", "block", "part")).applyInArrow(compare, schema)
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
