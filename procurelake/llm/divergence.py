"""Source divergence audit (operator 13): how far each source's choice of words lies from its language's others.

Two passes over the texts. The first counts document frequencies exactly (distinct terms of each text, combined
in each task before the shuffle) and keeps a language's frequent terms. The second is an automaton over the
kept terms, each with a delimiter before and after it, run by pyahocorasick over texts whose other characters
have become delimiters: it recounts occurrences. The counts are sparse postings (group, term, count); ranks come from them
and from what a group's missing terms have in common, so a table of all groups and terms is never made.

Kept terms are dealt into blocks of BLOCK_TERMS terms, whose keys have 67 bytes at most, and each block's
automaton takes a pass of its own; one block is the usual case. Pairs of sources are compared in cells of
bounded numbers of sources and terms, whose sums are added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurelake.llm.shared import quoted, slices, stash
from procurelake.llm.words import LONG_WORD, byte_table, chunks, short

#: Documents of a language from which a term is kept; ranks of the terms that are listed; added to each count.
MIN_DOCS, TOP_TERMS, SMOOTHING, SCALE = 30, 50, 5, 1_000_000_000
#: Terms of an automaton (at most 67 bytes each, so under 500 MB, usually 30); entries that a task counts before it passes them on.
BLOCK_TERMS, HELD = 200_000, 500_000
#: Sources and terms of a cell of comparisons, about.
CELL_SOURCES, CELL_TERMS, LEAST_CELLS = 128, 4096, 16
#: Parts of a group's terms that are ranked on their own first.
TERM_PARTS = 16
#: Bytes of groups up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Fixed value: terms are runs of these characters and of any that are not ASCII, A-Z in lower case.
TABLE = byte_table("abcdefghijklmnopqrstuvwxyz")
LONG_RUN = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): number of documents of each language with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [[], [], []]
            for lang, terms in counts.items():
                columns[0] += [lang] * len(terms)
                columns[1] += [t.decode("utf-8", "replace") for t in terms]
                columns[2] += terms.values()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "term", "n"])

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    terms: set[bytes] = set()
                    for piece in chunks(text, TABLE):
                        terms.update(piece.split())
                    own = counts.setdefault(lang, Counter())
                    before = len(own)
                    own.update(terms)
                    held += len(own) - before
                if held > HELD:
                    yield flush()
                    held = 0
        if counts:
            yield flush()

    told = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, term string, n bigint")
    return told.groupBy("lang", "term").agg(F.sum("n").alias("n"))


class Automata:
    """An automaton for each language over the delimited terms of a block."""

    def __init__(self, terms: list[tuple[int, str, str]]):
        self.by_lang: dict[str, ahocorasick.Automaton] = {}
        for number, lang, key in terms:
            self.by_lang.setdefault(lang, ahocorasick.Automaton()).add_word(f" {key} ", number)
        for a in self.by_lang.values():
            a.make_automaton()
        self.long = any(key[0] == "\x01" for _, _, key in terms)

    def occurrences(self, lang: str, text: bytes):
        """Numbers of the terms that occur, as often as they do."""
        found = self.by_lang.get(lang)
        if found is None:
            return
        for piece in chunks(text, TABLE):
            if self.long:
                piece = LONG_RUN.sub(lambda m: short(m[0]), piece)
            yield from map(itemgetter(1), found.iter(f" {piece.decode('utf-8', 'replace')} "))


def occurrences(docs: DataFrame, terms: list[tuple[int, str, str]]) -> DataFrame:
    """(lang, source, term, n): partial counts of the given terms (number, language, key) in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(shared.value)
        counts: dict[tuple[str, str], Counter] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, term, n) for (lang, source), c in counts.items() for term, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n"])

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = counts.setdefault((lang, source), Counter())
                    before = len(own)
                    own.update(automata.occurrences(lang, text))
                    held += len(own) - before + (before == 0)
                if held > HELD and any(counts.values()):
                    yield flush()
                    held = 0
        if any(counts.values()):
            yield flush()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term bigint, n bigint")


def kept_terms(docs: DataFrame, min_docs: int, block_terms: int) -> tuple[DataFrame, int]:
    """(number, lang, term, key, block) of the kept terms and the number of blocks; a block has ``block_terms`` terms at most."""
    frequent = document_frequencies(docs).where(F.col("n") >= min_docs)
    key = F.when(F.octet_length("term") <= LONG_WORD, F.col("term")).otherwise(F.concat(F.lit("\x01"), F.sha2("term", 256)))
    kept = stash(frequent.select(F.monotonically_increasing_id().alias("number"), "lang", "term", key.alias("key")), "kept")
    total = kept.count()
    blocks = 1 if total <= block_terms else -(-total * 5 // (block_terms * 4))
    while True:
        dealt = kept.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= block_terms:
            return dealt, blocks
        blocks *= 2


def share(count, total, n_terms):
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * n_terms)), exactly."""
    over = (F.coalesce(count, F.lit(0)) + SMOOTHING).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (F.coalesce(total, F.lit(0)) + F.lit(SMOOTHING) * n_terms).cast("decimal(28,0)")
    return 1 + F.call_function("div", over, under)


def small(df: DataFrame, bytes_a_row) -> DataFrame:
    """``df`` marked for broadcast if it was measured to be small; dealt out on its own otherwise, so that the join can be split."""
    n = df.agg(F.sum(bytes_a_row)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df.repartition(F.xxhash64(*df.columns[:1], F.lit(1)))


def compared_cell(key, table):
    """Differences of all pairs of sources of a cell, summed over its terms.

    Rows without a term are the sources (``p`` is the share of a term they do not have); others are postings.
    The sum over all terms is n_terms times the difference of two sources' shares of a missing term, which
    the first cell adds, and the excess over that of the terms that one of them has.
    """
    first, crossed = key[3].as_py() == 0, key[1].as_py() != key[2].as_py()
    term = table["term"].to_numpy(zero_copy_only=False)
    is_group = np.isnan(term.astype(float))
    gid, p = table["gid"].to_numpy(), table["p"].to_numpy()
    groups, order = np.unique(gid[is_group], return_index=True)
    base, side, n_terms = p[is_group][order], table["side"].to_numpy()[is_group][order], table["n_terms"].to_numpy()[is_group][order]
    columns, column = np.unique(term[~is_group].astype(np.int64), return_inverse=True)
    shares = np.repeat(base[:, None], len(columns), 1)
    shares[np.searchsorted(groups, gid[~is_group]), column] = p[~is_group]
    a, b, value = [], [], []
    for i in range(len(groups)):
        others = np.flatnonzero(side[i + 1 :] != side[i]) + i + 1 if crossed else np.arange(i + 1, len(groups))
        missing = np.abs(base[others] - base[i])
        total = np.abs(shares[others] - shares[i]).sum(1) - len(columns) * missing
        if first:
            total = total + n_terms[i] * missing
        else:
            others, total = others[total != 0], total[total != 0]
        a += [np.full(len(others), groups[i]), groups[others]]
        b += [groups[others], np.full(len(others), groups[i])]
        value += [total, total]
    put = lambda x: pa.array(np.concatenate([*x, np.empty(0, np.int64)]), pa.int64())
    return pa.table({"a": put(a), "b": put(b), "value": put(value)})


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(a, b, value): the summed differences of every ordered pair of groups of one language.

    ``groups(gid, lang, p0, n_terms, n_sources)``, ``postings(gid, lang, term, p, n_terms, n_sources)``.
    """
    blocks = F.expr(f"(n_sources + {CELL_SOURCES - 1}) div {CELL_SOURCES}")
    cells = F.expr(f"{LEAST_CELLS} + n_terms div {CELL_TERMS}")
    columns = ["lang", "gid", "term", "p", "n_terms", "n_sources", "cell"]
    rows = groups.withColumns({"term": F.lit(None).cast("long"), "p": F.col("p0"), "cell": F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))}).select(columns)
    rows = rows.unionByName(postings.withColumn("cell", F.pmod(F.xxhash64("term"), cells)).select(columns))
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("gid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("lang", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "cell", "gid", "term", "p", "n_terms", "side")
    sums = dealt.groupBy("lang", "low", "high", "cell").applyInArrow(compared_cell, "a bigint, b bigint, value bigint")
    return sums.groupBy("a", "b").agg(F.sum("value").alias("value"))


def source_divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance from the language's other sources, and the terms it prefers.

    Part ``pair`` has every other source of the language with the sum, over the kept terms, of the differences
    of the shares; part ``term`` has the kept terms of which the group has more than its language, with the
    difference, the first ``top_terms`` ranks. Shares are smoothed whole billionths, all arithmetic is exact.
    Ranks count from 1 by value descending, then item ascending by its UTF-8 bytes, so ties have one order. Nulls in text, language and
    source count as empty; groups without terms, and languages that keep none, are compared too (value 0);
    repeated rows are documents each; other columns are not read; an empty table gives an empty result.
    """
    clean = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    docs = df.select(clean(lang).alias("lang"), clean(source).alias("source"), clean(text).alias("text"))
    kept, blocks = kept_terms(docs, min_docs, block_terms)
    counted = None
    for b in range(blocks):
        terms = [(r.number, r.lang, r.key) for r in kept.where(F.col("block") == b).select("number", "lang", "key").collect()]
        part = occurrences(docs, terms).groupBy("lang", "source", "term").agg(F.sum("n").alias("count"))
        counted = part if counted is None else counted.unionByName(part)
    counted = stash(counted, "counted")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = counted.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    found = docs.select("lang", "source").distinct()
    # tables of one row per group or language; both are joined by equality and may be large
    sources = found.groupBy("lang").agg(F.count("*").alias("n_sources"))
    named = found.join(totals, ["lang", "source"], "left").join(sources, "lang").join(per_lang, "lang", "left")
    n_terms = F.coalesce("n_terms", F.lit(0))
    # a language without kept terms has no shares; its groups differ in nothing
    p0 = F.when(n_terms > 0, share(F.lit(0), F.col("total"), F.greatest(n_terms, F.lit(1)))).otherwise(0)
    groups = stash(named.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "n_sources", n_terms.alias("n_terms"), p0.alias("p0")), "groups")
    names = F.octet_length("lang") + F.octet_length("source") + 64
    postings = counted.join(small(groups, names), ["lang", "source"]).select("gid", "lang", "term", "n_terms", "n_sources", "count", share(F.col("count"), F.col("total"), F.col("n_terms")).alias("p"))
    postings = stash(postings, "postings")
    values = pair_values(groups, postings)
    who = [F.col("lang"), F.col("source")]
    pairs = values.join(small(groups.select(F.col("gid").alias("a"), *who), names), "a").join(small(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), F.octet_length("item") + 16), "b")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    by_term = postings.groupBy("term").agg(F.sum("count").alias("in_lang")).join(kept.select(F.col("number").alias("term"), F.col("term").alias("item"), "lang"), "term").join(small(whole, F.octet_length("lang") + 16), "lang")
    rare = postings.join(by_term.drop("lang"), "term").withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("whole"), F.col("n_terms"))).where("value > 0")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    # the first of parts of a group's terms, then of the group
    parts = rare.select("gid", "item", "value", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).alias("part"))
    first = parts.withColumn("rank", F.row_number().over(order("gid", "part"))).where(F.col("rank") <= top_terms).drop("part")
    best = first.withColumn("rank", F.row_number().over(order("gid"))).where(F.col("rank") <= top_terms)
    best = best.join(small(groups.select("gid", *who), names), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order("lang", "source"))).unionByName(best)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of all languages of the documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM g),
p AS MATERIALIZED (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p
      FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY lang),
lt AS (SELECT c.lang, term, 1 + (1000000000 * (sum(c.n)::HUGEINT + 5)) // (max(ln.n) + 5 * max(v.v)) AS q FROM c JOIN ln ON ln.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source = b.source WHERE x.lang = a.lang AND x.source = a.source), 0)::BIGINT AS value
          FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - lt.q)::BIGINT AS value FROM p JOIN lt ON lt.lang = p.lang AND lt.term = p.term WHERE p.n > 0 AND p.p > lt.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
