"""A search index that is kept up to date: rows and postings in generations, merged when they grow (OP-X1, OP-X2).

Each change writes a generation beside the base: the new rows, their postings, and the ids that it touches. An id
counts as its last generation says, so a row that was changed or removed is hidden in all earlier ones. A search
reads its words' postings of the base and of the few generations since, and the touched ids. A merge writes what
is current as the next base; the folders before it are read no more, and ``remove_merged`` deletes them. A
generation counts once its ids are written, which is done last, so one that died half-way is not there.

Rows go from where they are read to where they are written: what repeats or goes is found among the ids alone, and
only where these are too many to be sent to every task are rows shuffled, once and unsorted. Postings are made of the
written rows, task by task, in runs that are in order of lexeme, so that a search skips most pages of a file. Lexemes
lie in the postings only; beside a row they are made again when rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.operators.stores import there
from procurelake.search.match import postings_of_texts, with_index
from procurelake.shared import apart, stash

#: Generations after which, and share of the base's ids from which, changes are merged into a base.
MOST_GENERATIONS, MERGE_SHARE = 8, 0.25
#: So many ids are sent to every task at most.
FEW_IDS = 1_000_000
POSTINGS = "lexeme string, {key} {kind}, positions array<struct<pos:int,label:string>>"


class IndexStore:
    """An index over the columns ``fields`` (column -> label) of rows with the unique id ``key``.

    Rows without an id are left out; of rows repeated with their id in one change any one is taken; null texts have no lexemes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fields: dict[str, str], *, stemmed: bool = False, key: str = "id"):
        self.spark, self.path, self.fields, self.stemmed, self.key = spark, path.rstrip("/"), fields, stemmed, key
        kind = schema[key].dataType.simpleString()
        self.schemas = {
            "rows": schema, "postings": T._parse_datatype_string(POSTINGS.format(key=f"`{key}`", kind=kind)), "ids": T._parse_datatype_string(f"`{key}` {kind}"),
        }

    def folder(self, what: str, number: int) -> str:
        return f"{self.path}/{what}/generation={number}"

    def numbers(self) -> tuple[int, list[int]]:
        """(the base's number, those since), of the generations that were written whole; base -1 if there is none."""
        spark = self.spark
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ids")
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
        whole = sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("generation=")) if there(spark, f"{self.folder('ids', n)}/_SUCCESS"))
        base = max([n for n in whole if there(spark, f"{self.folder('base', n)}/_SUCCESS")], default=-1)
        return base, [n for n in whole if n > base]

    def read(self, what: str, numbers: list[int]) -> DataFrame:
        schema = T.StructType([*self.schemas[what].fields, T.StructField("generation", T.IntegerType())])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[self.folder(what, n) for n in numbers])

    def none(self) -> DataFrame:
        """No ids."""
        return self.spark.range(0).select(F.lit(None).cast(self.schemas["ids"][self.key].dataType).alias(self.key))

    def current(self, what: str, whole: bool = False) -> DataFrame:
        """The rows, without their lexemes, or postings that count; ``whole``: to be read whole, so what goes is counted first."""
        base, since = self.numbers()
        live = self.read(what, ([base] if base >= 0 else []) + since)
        if not since:
            return live.drop("generation")
        last = self.read("ids", since).groupBy(self.key).agg(F.max("generation").alias("last"))
        met = live.join(self.beside(last) if whole else apart(last, self.key), self.key, "left")
        return met.where("last is null or generation = last").select(*self.schemas[what].names)

    def beside(self, ids: DataFrame) -> DataFrame:
        """``ids``, one row each, as the right side of a join: sent to every task if they are few, else dealt out, and neither side is sorted."""
        stored = stash(ids, "ids")
        return F.broadcast(stored) if stored.count() <= FEW_IDS else apart(stored, self.key).hint("shuffle_hash")

    def rows(self) -> DataFrame:
        """The rows with their lexemes."""
        return with_index(self.current("rows"), self.fields, stemmed=self.stemmed)

    def postings(self) -> DataFrame:
        """Postings as ``matching_ids`` and ``search`` take them; a filter on lexemes reaches the files, which hold runs in their order."""
        return self.current("postings")

    def write(self, rows: DataFrame, gone: DataFrame, number: int, base: bool = False) -> None:
        """A generation of ``rows``, of which none has an id that is ``gone``; it touches both."""
        names = self.schemas["rows"].names
        put = lambda df, what: df.write.mode("overwrite").option("compression", "zstd").parquet(self.folder(what, number))
        put(rows.select(*names), "rows")
        stored = self.spark.read.schema(self.schemas["rows"]).parquet(self.folder("rows", number))
        # ids are unique here
        put(postings_of_texts(stored, self.fields, stemmed=self.stemmed, key=self.key), "postings")
        if base:
            put(gone.limit(0), "base")
        put(stored.select(self.key).unionByName(gone), "ids")

    def change(self, upserts: DataFrame | None = None, removed: DataFrame | None = None, number: int | None = None) -> bool:
        """Add or replace the rows ``upserts`` and remove the ids ``removed``; an id in both is removed. False if the change ``number`` is there already.

        Without a number the change is the next; a stream gives its batch's, so that a batch that is run again does nothing.
        """
        base, since = self.numbers()
        newest = max([base, *since])
        number = newest + 1 if number is None else number
        if number <= newest:
            return False
        key = F.col(self.key)
        gone = removed.select(self.key).where(key.isNotNull()).distinct() if removed is not None else self.none()
        fresh = self.spark.createDataFrame([], self.schemas["rows"])
        if upserts is not None:
            fresh = upserts.where(key.isNotNull())
            again = stash(fresh.groupBy(self.key).count().where("count > 1").select(self.key), "ids")
            if not again.isEmpty():
                among = lambda how: fresh.join(self.beside(again), self.key, how)
                fresh = among("left_anti").unionByName(among("left_semi").dropDuplicates([self.key]))
            if removed is not None:
                fresh = fresh.join(self.beside(gone), self.key, "left_anti")
        self.write(fresh, gone, number)
        return True

    def merge(self) -> int:
        """Write what is current as the next base."""
        base, since = self.numbers()
        number = max([base, *since]) + 1
        self.write(self.current("rows", whole=True), self.none(), number, base=True)
        return number

    def remove_merged(self) -> int:
        """Delete the generations before the base, which nobody may be reading any more; how many folders went."""
        base, _ = self.numbers()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store, gone = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        # the ids go first: without them a generation is not there
        for what in ("ids", "base", "postings", "rows"):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
            names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
            old = [int(x.partition("=")[2]) for x in names if x.startswith("generation=")]
            gone += sum(store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(what, n)), True) for n in old if n < base)
        return gone

    def merge_if_grown(self) -> bool:
        """Merge if there are many generations, or if they touch a good part of the base."""
        base, since = self.numbers()
        if not since:
            return False
        touched, whole = self.read("ids", since).count(), self.read("ids", [base] if base >= 0 else []).count()
        if len(since) < MOST_GENERATIONS and touched < MERGE_SHARE * whole:
            return False
        self.merge()
        return True
