"""Stored tables that a batch touches in part: unique keys behind Bloom filters, tender state in buckets, history that only grows (SNK-1 to SNK-6, SNK-10, 2.14, 2.15).

All tables are folders of Parquet files in buckets by key, so that what a batch reads and rewrites depends on
the batch and not on the store. Batches have numbers; a batch that is run again, after a failure at any
point or for no reason, changes nothing. One writer at a time is assumed, as a streaming query is.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.operators.versions import fold, identities, insert_ignore
from procurelake.shared import stash

#: Buckets of a table; bits of a bucket's filter (256 KB) and bits set for a key: one key in a hundred is suspected wrongly at 200,000 keys a bucket.
BUCKETS, FILTER_BITS, FILTER_HASHES = 64, 1 << 21, 7


def there(spark: SparkSession, path: str) -> bool:
    """Whether anything was written at ``path``, in whatever store Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Buckets:
    """A folder of Parquet files in buckets, of which some are read or replaced."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the buckets ``only``, or of all; others are not opened."""
        if not there(self.spark, self.path) or only == []:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def append(self, rows: DataFrame) -> None:
        self.files(rows).mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Replace the buckets that ``rows`` have; the files of others stay as they are. ``rows`` must not read from here: stash them."""
        self.files(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def files(self, rows: DataFrame):
        # a bucket's rows go to a few tasks, so that it gets a few files
        return rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "bucket"]), F.lit(4))).write.partitionBy("bucket")


def numbers(buckets: DataFrame) -> list[int]:
    """The distinct buckets of ``buckets``: at most as many numbers as the table has buckets."""
    return sorted(r.bucket for r in buckets.select("bucket").distinct().collect())


class Inserted(NamedTuple):
    """The rows that were new, and the buckets whose rows had to be read to find out."""

    fresh: DataFrame
    read: list[int]


class UniqueTable:
    """SNK-2, SNK-4, SNK-6, SNK-10. Rows under a unique key; inserts ignore what is there.

    Beside each bucket of rows lies a Bloom filter of its keys, rows (word, bits) made by ``bit_or`` and
    added to by every insert. An insert probes the filters of the buckets that its keys belong to and reads the rows of those
    buckets only in which a key is suspected; an exact anti-join decides. So a batch of new keys reads no
    stored rows, however many there are. The filter is written before the rows: if a job dies in between,
    the filter suspects too much and nothing is stored twice. Keys with a null are stored without question.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS, bits: int = FILTER_BITS):
        self.keys, self.bits, self.buckets = keys, bits, buckets
        self.rows = Buckets(spark, f"{path.rstrip('/')}/rows", schema, buckets)
        self.filters = Buckets(spark, f"{path.rstrip('/')}/filters", T._parse_datatype_string("word bigint, bits bigint"), buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def places(self, df: DataFrame) -> DataFrame:
        """(bucket, key, word, mask): the filter bits of each key, one row for each."""
        first, step = F.xxhash64(*self.keys, F.lit(1)), F.xxhash64(*self.keys, F.lit(2)).bitwiseOR(F.lit(1))
        keyed = df.select("bucket", F.xxhash64(*self.keys, F.lit(3)).alias("key"), first.alias("first"), step.alias("step")).distinct()
        place = F.expr(f"transform(sequence(0, {FILTER_HASHES - 1}), i -> pmod(try_add(first div 16, i * (step div 256)), {self.bits}))")
        rows = keyed.select("bucket", "key", F.explode(place).alias("place"))
        return rows.select("bucket", "key", F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("mask"))

    def suspected(self, df: DataFrame) -> list[int]:
        """Buckets that may hold a key of ``df``; those left out hold none."""
        places = self.places(df)
        stored = self.filters.read(numbers(df)).groupBy("bucket", "word").agg(F.expr("bit_or(bits)").alias("bits"))
        met = places.join(stored, ["bucket", "word"], "left").groupBy("bucket", "key").agg(F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False))).alias("all"))
        return numbers(met.where("all"))

    def insert(self, batch: DataFrame, order: str | None = None) -> Inserted:
        """Store the rows whose key is new, of several under one key the first by ``order``; running it again stores nothing."""
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        rows = batch.withColumn("bucket", self.bucket())
        read = self.suspected(rows.where(known))
        fresh = stash(insert_ignore(self.rows.read(read), rows, self.keys, order), "fresh")
        places = self.places(fresh.where(known))
        self.filters.append(places.groupBy("bucket", "word").agg(F.expr("bit_or(mask)").alias("bits")))
        self.rows.append(fresh)
        return Inserted(fresh.drop("bucket"), read)

    def all(self) -> DataFrame:
        return self.rows.read().drop("bucket")

    def compact(self, buckets: list[int] | None = None) -> None:
        """Rewrite buckets whose inserts left many small files, and their filters as one row a word."""
        for table in (self.rows, self.filters):
            held = table.read(buckets)
            if table is self.filters:
                held = held.groupBy("word", "bucket").agg(F.expr("bit_or(bits)").alias("bits")).select("word", "bits", "bucket")
            table.replace(stash(held, "compacted"))


class History:
    """2.15. A table that only grows: each batch is written once and never again; there is no way to change or remove rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Write the batch's rows; False, and nothing written, if the batch was written before. A job that died in between left no success mark and is repeated."""
        if self.has(batch):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def has(self, batch: int) -> bool:
        return there(self.spark, f"{self.path}/batch={batch}/_SUCCESS")

    def all(self, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(whole).parquet(self.path) if there(self.spark, self.path) else self.spark.createDataFrame([], whole)


VERSIONS = "tender_id string, version_no int, kind string, changes array<struct<field:string,old:string,new:string>>"


class TenderStore:
    """SNK-1, SNK-5. Tenders under natural key and fingerprint, folded batch by batch.

    State lies in buckets by tender_id and an index (key, tender_id) in buckets by key. A batch looks its keys
    up in the index buckets they belong to, reads the state buckets of the tenders found and of those it creates, and
    rewrites these; other files stay. Which tender an arrival is, is decided and written once, and each tender
    has the number of the last batch that it took part in, so a batch that is run again leaves it as it is even
    where the arrivals changed keys or fields to and fro. ``updated_at`` is that of the last batch that changed
    the tender. Arrivals and versions are history: written once, before the state. The arrivals of batches that are done serve no further purpose and may go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        """``schema``: the columns of the arrivals, as ``upsert`` takes them, without the order."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.columns = ["tender_id", "version_no", *schema.names, "batch", "updated_at"]
        kinds = [("tender_id", T.StringType()), ("version_no", T.IntegerType()), *[(f.name, f.dataType) for f in schema.fields], ("batch", T.LongType()), ("updated_at", T.TimestampType())]
        self.state = Buckets(spark, f"{self.path}/state", T.StructType([T.StructField(n, k) for n, k in kinds]), buckets)
        self.index = Buckets(spark, f"{self.path}/index", T._parse_datatype_string("key string, tender_id string"), buckets)
        self.history, self.arrivals = History(spark, f"{self.path}/versions"), History(spark, f"{self.path}/arrivals")

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def keys(self, rows: DataFrame, *more: str) -> DataFrame:
        """(key, bucket, ...) of the rows' natural keys and fingerprints."""
        both = F.array_compact(F.array(F.concat(F.lit("n:"), "natural_key"), F.concat(F.lit("f:"), "fingerprint")))
        return rows.select(F.explode(both).alias("key"), *more).distinct().withColumn("bucket", self.bucket("key"))

    def found(self, ids: DataFrame) -> DataFrame:
        """The stored rows of the tenders ``ids(tender_id)``."""
        placed = ids.withColumn("bucket", self.bucket("tender_id"))
        return self.state.read(numbers(placed)).join(placed.select("tender_id"), "tender_id", "left_semi").drop("bucket")

    def upsert(self, batch: DataFrame, number: int, as_of: datetime | Column, order: str = "seen_at") -> list[int]:
        """Fold the batch in; the state buckets that were rewritten. ``as_of`` stamps the tenders that it changes."""
        schema = T.StructType([T.StructField("tender_id", T.StringType()), *batch.schema.fields])
        if not self.arrivals.has(number):
            wanted = self.keys(batch)
            pairs = self.index.read(numbers(wanted)).join(wanted.select("key"), "key", "left_semi").select("tender_id").distinct()
            self.arrivals.append(identities(self.found(stash(pairs, "pairs")), batch, order).select(*schema.names), number)
        arrivals = self.arrivals.all(schema).where(F.col("batch") == number).drop("batch")
        existing = stash(self.found(arrivals.select("tender_id").distinct()), "existing")
        # of a batch that was run in part, what it did is not done twice
        done = existing.where(F.col("batch") >= number).select("tender_id")
        existing = existing.join(done, "tender_id", "left_anti")
        folded, versions = fold(existing.drop("batch", "updated_at"), arrivals.join(done, "tender_id", "left_anti"), order)
        same = [F.col(c) for c in folded.columns if c in self.columns]
        was = existing.select(F.col("tender_id").alias("__id"), F.to_json(F.struct(*same)).alias("__was"), F.col("updated_at").alias("__at"))
        met = folded.join(was, F.col("tender_id") == F.col("__id"), "left")
        stamp = F.when(F.to_json(F.struct(*same)).eqNullSafe(F.col("__was")), F.col("__at")).otherwise((as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp"))
        state = stash(met.withColumns({"batch": F.lit(number).cast("long"), "updated_at": stamp}).select(*self.columns).withColumn("bucket", self.bucket("tender_id")), "state")
        touched = numbers(state)
        others = self.state.read(touched).join(state.select("tender_id"), "tender_id", "left_anti")
        whole = stash(others.select(*self.columns, "bucket").unionByName(state), "buckets")
        self.history.append(versions, number)
        fresh = self.keys(state, "tender_id")
        held = self.index.read(numbers(fresh)).select("key", "tender_id")
        self.index.append(stash(fresh.join(held, ["key", "tender_id"], "left_anti").select("key", "tender_id", "bucket"), "index"))
        if touched:
            self.state.replace(whole)
        return touched

    def tenders(self) -> DataFrame:
        return self.state.read().drop("bucket")

    def versions(self) -> DataFrame:
        return self.history.all(T._parse_datatype_string(VERSIONS))
