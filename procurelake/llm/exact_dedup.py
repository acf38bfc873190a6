"""Exact deduplication with an extendible-hash index (operator 7); DataFrame functions only.

Keys are 64-bit hashes of the normalised text. The index lies in the shared folder: a directory over the
leading key bits, doubled until no bucket holds more entries than its capacity (a bucket keeps the
shallowest depth at which it fits, so only overfull ones split), and bucket files that owner tasks write by
ranges of the directory. Where a directory at its greatest depth still has overfull slots, each of them gets
a directory of its own over the next bits. Texts with equal keys are compared byte by byte when entries are
made; texts that differ under one key are chained in their bucket. An entry has the number of its rows and
the id that stays; every row finds its entry by slot, bucket, key and chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurelake.llm.shared import quoted, stash, text_or_empty, unused

#: Entries that a bucket holds before it splits, and the bits that a directory has at most (65,536 slots, so
#: that a directory stays under 2 MB and may be broadcast).
CAPACITY = 65_536
MAX_DEPTH = 16
KEY_BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str):
    """A-Z lower-cased and nothing else; null counts as empty. Texts of single-byte characters take the faster function."""
    t = text_or_empty(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def slot_of(key, bits: int):
    """The leading ``bits`` of a key."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directories(entries: DataFrame, capacity: int, max_depth: int) -> list[tuple[int, DataFrame, int]]:
    """(bits of a slot, slots, their number) of the directory and of those below it; slots are (slot, bucket, depth).

    A directory doubles from one slot on until every bucket fits; a slot's bucket is the range of keys at the
    least depth that fits, named by its first key. What fits at no depth goes to the next directories, as long
    as keys have bits left.
    """
    out, rest = [], entries.select("key")
    for bits in range(max_depth, KEY_BITS + 1, max_depth):
        slots = stash(rest.groupBy(slot_of(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n")), "slots")
        doubled = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {max_depth} - depth)"))
        last = bits + max_depth > KEY_BITS
        fits = doubled.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.lit(last) & (F.col("depth") == max_depth)))
        local = doubled.join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("d"))
        first_key = F.expr(f"shiftleft(shiftleft(shiftrightunsigned(slot, {max_depth} - d), {max_depth} - d), {KEY_BITS - bits})")
        table = stash(local.select("slot", first_key.alias("bucket"), (F.col("d") + (bits - max_depth)).alias("depth")), "directory")
        overfull = slots.join(table, "slot", "left_anti").select("slot")
        out.append((bits, table, table.count()))
        if last or overfull.isEmpty():
            break
        rest = rest.withColumn("slot", slot_of(F.col("key"), bits)).join(overfull, "slot", "left_semi").select("key")
    return out


def routed(df: DataFrame, found: list[tuple[int, DataFrame, int]]) -> DataFrame:
    """``df`` with the bucket and depth of each ``key``, or null where no directory has its slot."""
    out = df.withColumns({"bucket": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})
    for bits, table, n in found:
        named = table.select(F.col("slot").alias("s"), F.col("bucket").alias("b"), F.col("depth").alias("d"))
        met = out.join(F.broadcast(named) if n <= 1 << MAX_DEPTH else named, slot_of(F.col("key"), bits) == F.col("s"), "left")
        out = met.withColumns({"bucket": F.coalesce("bucket", "b"), "depth": F.coalesce("depth", "d")}).drop("s", "b", "d")
    return out


def open_index(df: DataFrame, id_col: str, text: str, capacity: int, max_depth: int, key) -> tuple[DataFrame, list[tuple[int, DataFrame, int]]]:
    """(index, directories): entries (bucket, depth, key, chain, sha, n, keep_id) of the distinct normalised texts."""
    compared = df.select(F.col(quoted(id_col)).alias("id"), normalised(text).alias("norm")).groupBy(key(F.col("norm")).alias("key"), "norm")
    made = compared.agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
    entries = stash(made.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "keep_id"), "entries")
    found = directories(entries, capacity, max_depth)
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha")) - 1
    owned = routed(entries, found).repartitionByRange("bucket", "key")
    return stash(owned.select("bucket", "depth", "key", chain.alias("chain"), "sha", "n", "keep_id"), "index"), found


def build_index(df: DataFrame, text: str = "text", *, id_col: str = "doc_id", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key=F.xxhash64) -> DataFrame:
    """The index of the distinct normalised texts: (bucket, depth, key, chain, sha, n, keep_id), ``n`` rows having the text and ``keep_id`` the largest of their ids.

    Copies are combined in each task before their text is shuffled, so a text that a third of all rows have
    costs one row per task. ``key`` can be given in tests, to make keys collide. An empty table has an empty index.
    """
    return open_index(df, id_col, text, capacity, max_depth, key)[0]


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key=F.xxhash64
) -> DataFrame:
    """One row for each row of ``df``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, so all null and
    empty texts are one group. Of equal texts the row with the largest id stays; a null id ranks lowest, and
    of rows that are repeated with their id one stays. Other columns are not read, whatever their names; an
    empty table gives an empty result; texts are compared whole, of any length.
    """
    own = df.select(F.col(quoted(id_col)).alias("id"), F.monotonically_increasing_id().alias("row"), normalised(text).alias("norm"))
    rows = stash(own.select("id", "row", key(F.col("norm")).alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "rows")
    index, found = open_index(df, id_col, text, capacity, max_depth, key)
    # the entries of texts that occur once need no look-up: their row stays
    entries = index.where("n > 1").select("bucket", "key", "sha", "chain", "n", "keep_id")
    met = stash(routed(rows, found).drop("depth").join(entries, ["bucket", "key", "sha"], "left"), "found")
    stays = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    # rows that are repeated with the id that stays: the last of them does
    several = met.where(F.col("n").isNotNull() & stays).groupBy("bucket", "key", "chain").agg(F.max("row").alias("last"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    repeated = stash(several, "repeated")
    if not repeated.isEmpty():
        met = met.join(repeated, ["bucket", "key", "chain"], "left")
        stays = stays & (F.col("last").isNull() | (F.col("row") == F.col("last")))
    return met.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names; of rows repeated with id and text one stays.

    Rows are told apart by id and text digest. Only where some are repeated with both do the rest have to be
    made distinct. Null and empty texts are one group; an empty table stays empty.
    """
    verdicts = stash(exact_dedup(df, id_col, text).select(F.col(quoted(id_col)).alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "kept"), "verdicts")
    told = verdicts.groupBy("gone_id", "gone_sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    id_name, sha_name = unused(df, "gone_id"), unused(df, "gone_sha")
    gone = told.where("not kept").select(F.col("gone_id").alias(id_name), F.col("gone_sha").alias(sha_name))
    mark = unused(df, "text_sha")
    marked = df.withColumn(mark, F.sha2(normalised(text), 256))
    stay = marked.join(gone, F.col(quoted(id_col)).eqNullSafe(F.col(id_name)) & (F.col(mark) == F.col(sha_name)), "left_anti")
    if not told.where("n > 1 and kept").isEmpty():
        stay = stay.dropDuplicates([id_col, mark])
    return stay.select(*[F.col(quoted(c)) for c in df.columns])


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; one row per document."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
