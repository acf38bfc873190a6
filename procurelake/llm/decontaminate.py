"""Benchmark decontamination (operator 11).

Windows of consecutive words of the benchmark's items are a broadcast hash set; the words of each text are
numbered by the benchmark's vocabulary and every window of them is looked up. A hit is verified word by word,
so a hash decides nothing. Found spans, or the documents that have them, can be removed.

The set has a checked bound: items are cut into pieces of words (overlapping by a window), pieces are dealt
into blocks of BLOCK_WORDS words at most, and each block is broadcast in a pass of its own. A word of more
than 64 bytes is represented by its SHA-256, so words bound bytes. One block, the usual case, takes one pass
without any shuffle; several meet again by row number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, quoted, stash, unused
from procurelake.llm.words import byte_table, chunks, mix, short

WINDOW = 10
#: Words of a block at most (under 200 MB as tables of a task, even where all are different and 64 bytes long), and of a piece.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 4096
#: Fixed value: words are runs of these characters and of any that are not ASCII, A-Z in lower case.
WORD_CHARS = "0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = byte_table(WORD_CHARS)
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")]))
ARROW_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def benchmark_pieces(benchmark: DataFrame, item: str, text: str, window: int, piece_words: int) -> DataFrame:
    """(item, words, n): distinct pieces of the items' words, each holding whole windows; every window is in a piece."""
    own = benchmark.select(F.col(quoted(item)).cast("string").alias("item"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [short(w) for part in chunks(data, TABLE) for w in part.split()]
                cut = [words[lo : lo + piece_words] for lo in range(0, max(1, len(words) - window + 1), piece_words - window + 1)]
                rows = [(name, b" ".join(c), len(c)) for c in cut if c]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["item", "words", "n"])

    return own.mapInArrow(run, "item string, words binary, n bigint").distinct()


class WindowSet:
    """The windows of a block of pieces: hashes to look up, words to verify, items to name."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int):
        self.names = sorted({name for name, _ in pieces if name is not None})
        places = {name: i for i, name in enumerate(self.names)} | {None: -1}
        cut = [(places[name], words.split()) for name, words in pieces]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in cut:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.long = any(w[:1] == b"\x01" for w in self.vocabulary)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for place, words in cut:
            ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
            by_length.setdefault(min(window, len(ids)), []).append((place, ids))
        self.tables = [WindowTable(k, group) for k, group in sorted(by_length.items())]

    def ids(self, text: bytes) -> np.ndarray:
        """A number for each word of the text, 0 for words that the block does not have."""
        parts = []
        for part in chunks(text, TABLE):
            words = part.split()
            known = map(self.vocabulary.get, map(short, words) if self.long else words, repeat(0))
            parts.append(np.fromiter(known, np.int32, len(words)))
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.int32)])


class WindowTable:
    """Distinct windows of ``k`` words by their hash, and the items of each."""

    def __init__(self, k: int, pieces: list[tuple[int, np.ndarray]]):
        self.k = k
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, k) for _, ids in pieces])
        items = np.concatenate([np.full(len(ids) - k + 1, place, np.int64) for place, ids in pieces])
        for seed in range(64):
            self.weights = np.random.default_rng(seed).integers(1, 1 << 63, k, np.uint64) | np.uint64(1)
            hashes = mix((rows.astype(np.uint64) * self.weights).sum(1, dtype=np.uint64))
            self.hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            self.rows = rows[first]
            if (self.rows[which] == rows).all():
                break  # no two different windows have one hash
        else:
            raise RuntimeError("windows cannot be told apart by hashes")
        pairs = np.unique(np.stack([which.reshape(-1), items], 1), axis=0)
        self.items = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.hashes) + 1))
        bits = min(24, max(12, int(len(self.hashes)).bit_length() + 3))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``ids``, windows) of all occurrences."""
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wide = ids.astype(np.uint64)
        total = wide[:n] * self.weights[0]
        for j in range(1, self.k):
            total += wide[j : n + j] * self.weights[j]
        total = mix(total)
        at = np.flatnonzero(self.seen[(total >> self.shift).astype(np.int64)])
        window = np.minimum(np.searchsorted(self.hashes, total[at]), len(self.hashes) - 1)
        same = self.hashes[window] == total[at]
        at, window = at[same], window[same]
        same = (ids[at[:, None] + np.arange(self.k)] == self.rows[window]).all(1)
        return at[same], window[same]


def scan_texts(block: WindowSet, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """(words, spans, items) of each text; spans are maximal runs of hit words, in words and in code points."""
    numbered = [block.ids(t) for t in texts]
    n_words = np.array([len(x) for x in numbered], np.int64)
    # a word that no window has stands between texts, so that no window reaches from one into the next
    gap = np.zeros(1, np.int32)
    flat = np.concatenate([x for ids in numbered for x in (ids, gap)]) if texts else gap
    begins = np.cumsum(n_words + 1) - n_words - 1
    depth = np.zeros(len(flat) + 1, np.int64)
    found = []
    for table in block.tables:
        at, window = table.hits(flat)
        if len(at):
            np.add.at(depth, at, 1)
            np.add.at(depth, at + table.k, -1)
            met = np.unique(np.stack([np.searchsorted(begins, at, "right") - 1, window], 1), axis=0)
            sizes = table.starts[met[:, 1] + 1] - table.starts[met[:, 1]]
            place = np.repeat(table.starts[met[:, 1]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found.append(np.unique(np.stack([np.repeat(met[:, 0], sizes), table.items[place]], 1), axis=0))
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if found:
        for doc, item in np.unique(np.concatenate(found), axis=0).tolist():
            if item >= 0:
                items[doc].append(block.names[item])
        hit = np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8), [0]]))
        runs = np.stack([np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)], 1)
        docs = np.searchsorted(begins, runs[:, 0], "right") - 1
        for doc in np.unique(docs).tolist():
            places = [m.span() for m in WORD.finditer(texts[doc].decode("utf-8", "replace"))]
            for first, last in (runs[docs == doc] - begins[doc]).tolist():
                spans[doc].append({"first": first, "last": last, "start": places[first][0], "end": places[last - 1][1]})
    return n_words, spans, items


def scan_block(df: DataFrame, text: str, block: WindowSet, names: tuple[str, str, str], drop=()) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)

    def make():
        windows = shared.value

        def compute(texts: pa.Array):
            n_words, spans, items = scan_texts(windows, texts.to_pylist())
            return [pa.array(n_words, pa.int64()), pa.array(spans, ARROW_SPANS), pa.array(items, pa.list_(pa.string()))]

        return compute

    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))]
    given = F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).cast("binary")
    return append_columns(df, [given], fields, make, drop=drop)


def dealt_pieces(pieces: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """The pieces with their ``block``, and how many blocks it takes so that none has more than ``block_words`` words."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= block_words else -(-total * 5 // (block_words * 4))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= block_words:
            return dealt, blocks
        blocks *= 2


def united(df: DataFrame) -> DataFrame:
    """Overlapping and touching spans of ``spans`` become one, as if one block had found them."""

    def make():
        def compute(lists: pa.Array):
            out = []
            for spans in lists.to_pylist():
                merged: list[dict] = []
                for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
                    if merged and s["first"] <= merged[-1]["last"]:
                        if s["last"] > merged[-1]["last"]:
                            merged[-1] = merged[-1] | {"last": s["last"], "end": s["end"]}
                    else:
                        merged.append(s)
                out.append(merged)
            return [pa.array(out, ARROW_SPANS)]

        return compute

    return append_columns(df, ["spans"], [T.StructField("spans", SPANS)], make)


def scan_benchmark(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    *, names: tuple[str, str, str] = ("n_words", "spans", "items"), window: int = WINDOW, block_words: int = BLOCK_WORDS, drop=(),
) -> DataFrame:
    """Append what each whole text shares with the benchmark: its number of words, spans of hit words, and items.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one of none has
    none. Spans are maximal runs of words inside occurrences: (first, last) in words and (start, end) in code
    points, ends exclusive. Items are the ids, as text in order, whose windows occur. Null and empty texts have
    no words. Repeated items count once; windows of items with a null id are hit without a name. Repeated rows
    are scanned each; an empty benchmark hits nothing; columns with the names of the outputs are replaced,
    others pass through whatever their names; an empty table stays empty.
    """
    if block_words < window:
        raise ValueError("a block has to hold a window")
    pieces = stash(benchmark_pieces(benchmark, item, item_text, window, min(PIECE_WORDS, max(window, block_words // 4))), "pieces")
    dealt, blocks = dealt_pieces(pieces, block_words)
    one = lambda b: WindowSet([(r["item"], bytes(r["words"])) for r in dealt.where(F.col("block") == b).select("item", "words").collect()], window)
    if blocks == 1:
        return scan_block(df, text, one(0), names, drop)
    row, gone = unused(df, "row"), {x.lower() for x in (*names, *drop)}
    rows = stash(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(quoted(row)).alias("row"), F.col(quoted(text)).alias("text"))
    parts = [stash(scan_block(own, "text", one(b), ("n_words", "spans", "items"), ["text"]), "found") for b in range(blocks)]
    hit = parts[0].where("size(spans) > 0").select("row", "spans", "items")
    for part in parts[1:]:
        hit = hit.unionByName(part.where("size(spans) > 0").select("row", "spans", "items"))
    whole = united(hit.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    met = parts[0].select("row", "n_words").join(whole, "row", "left").select(F.col("row").alias("found_row"), *[F.struct("n_words", "spans", "items").alias("found_what")])
    met = met.withColumnsRenamed({"found_row": unused(rows, "found_row"), "found_what": unused(rows, "found_what")})
    key, what = met.columns
    keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]
    none = lambda c, kind: F.coalesce(F.col(what)[c], F.array().cast(kind))
    return rows.join(met, F.col(quoted(row)) == F.col(key)).select(
        *keep, F.col(what)["n_words"].alias(names[0]), none("spans", SPANS).alias(names[1]), none("items", "array<string>").alias(names[2])
    )


def hit_words(spans):
    """Number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", *, remove: str = "spans", share: float = 0.0, **options) -> DataFrame:
    """``df`` without what it shares with the benchmark.

    ``remove="spans"`` cuts the spans out of the texts and keeps all rows; ``remove="documents"`` drops the rows
    of which more than ``share`` of the words are hit. Columns stay as they are; the cases of ``scan_benchmark`` hold.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    names = tuple(unused(df, n) for n in ("n_words", "spans", "items"))
    found = scan_benchmark(df, benchmark, text, names=names, **options)
    n_words, spans, own = F.col(names[0]), F.col(names[1]), F.col(quoted(text))
    if remove == "documents":
        return found.where((hit_words(spans) == 0) | (hit_words(spans) <= F.lit(share) * n_words)).select(*[F.col(quoted(c)) for c in df.columns])
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(own).cast("long")))
    rest = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(own, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")
    cut = F.when(F.size(spans) > 0, rest).otherwise(own).alias(text)
    return found.select(*[cut if c == text else F.col(quoted(c)) for c in df.columns])


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=["text"])
    n_hit = hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, len(w) AS n, w FROM lowered),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
places AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS s FROM places),
lengths AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, w, k, unnest(range(greatest(n - k + 1, 0))) AS i FROM d, lengths),
met AS MATERIALIZED (SELECT doc_id, i, x.k, item_id FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS s FROM spots) x JOIN windows v ON v.k = x.k AND v.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
