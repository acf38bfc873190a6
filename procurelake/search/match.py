"""Indexing, matching, ranking, paging and highlighting (OP-X1, OP-X2, OP-X6 to OP-X14, OP-P4 to OP-P8, OP-S1, OP-S2)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.text import END_MARK, MARK, html_escape
from procurelake.functions.vectors import cosine_at_least_zero
from procurelake.search.parse import Term, expand, literal
from procurelake.search.stem import stem
from procurelake.shared import stash

#: Weights of the labels, of the signals, and the points of the urgency curve.
LABELS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
KEYWORD, AUTHORITY, URGENCY, VECTOR = 1.0, 0.25, 0.35, 0.6
NO_DEADLINE, CLOSED, TOO_SOON, FAR = 0.15, 0.0, 0.35, 0.1
FLOOR_HOURS, HORIZON_DAYS = 12, 30
STATUSES = ("UNKNOWN", "NEW", "OPEN", "CLOSING_SOON", "CLOSED", "EXTENDED", "RE_ADVERTISED", "CANCELLED", "AWARDED")
PROVINCES = ("Eastern Cape", "Free State", "Gauteng", "KwaZulu-Natal", "Limpopo", "Mpumalanga", "North West", "Northern Cape", "Western Cape")
MOST_ROWS = 100
SNIPPET_WORDS = 35


def words_of(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def stem_lists(column: pa.Array) -> pa.Array:
    """Lists of words stemmed; a word is stemmed once a batch, however often it comes."""
    words = column.flatten().dictionary_encode()
    made = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), made, mask=column.is_null())


def stems(words) -> Column:
    """The array's words stemmed (Arrow batches)."""
    return F.arrow_udf(stem_lists, T.ArrayType(T.StringType()))(words)


def _at(start: Column, label: str):
    return lambda w, i: F.struct(w.alias("lexeme"), (start + i + 1).cast("int").alias("pos"), F.lit(label).alias("label"))


def with_index(df: DataFrame, fields: dict[str, str], *, stemmed: bool = False) -> DataFrame:
    """OP-X1. ``df`` with ``lexemes`` (array of lexeme, position, label) from the columns in ``fields`` (column -> label).

    Meant to be stored at write time: queries then read no text. Positions run on over the fields.
    """
    names = [f"__words_{i}" for i in range(len(fields))]
    words = {n: stems(words_of(c)) if stemmed else words_of(c) for n, c in zip(names, fields, strict=True)}
    cut = df.withColumns(words)
    out, start = F.array().cast("array<struct<lexeme:string,pos:int,label:string>>"), F.lit(0)
    for name, label in zip(names, fields.values(), strict=True):
        out = F.concat(out, F.transform(name, _at(start, label)))
        start = start + F.size(name) + 1
    return cut.withColumn("lexemes", out).drop(*names)


#: Rows of a piece in which postings go back to Spark, and how a place is stored.
PIECE = 50_000
PLACE = pa.struct([("pos", pa.int32()), ("label", pa.string())])


def _turned(key: str, keys: pa.Array, words: pa.Array, row: np.ndarray, pos: np.ndarray, labels: pa.Array) -> Iterable[pa.RecordBatch]:
    """The postings of words that stand in the rows ``row`` of ``keys``, at ``pos`` and with ``labels``; in order of lexeme and row."""
    if not len(words):
        return
    coded = words.dictionary_encode(null_encoding="encode")
    in_order = pc.sort_indices(coded.dictionary)
    # numbers of 16 bits are sorted in less time
    rank = np.empty(len(in_order), np.uint16 if len(in_order) <= 1 << 16 else np.int32)
    rank[in_order.to_numpy()] = np.arange(len(in_order))
    word = rank[coded.indices.to_numpy()]
    before = np.arange(0) if np.all((row[1:] > row[:-1]) | (row[1:] == row[:-1]) & (pos[1:] >= pos[:-1])) else np.lexsort((pos, row))
    order = before[np.argsort(word[before], kind="stable")] if len(before) else np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])))
    places = pa.StructArray.from_arrays([pa.array(pos[order], pa.int32()), labels.take(pa.array(order))], fields=list(PLACE))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), places)
    columns = [coded.dictionary.take(in_order).take(pa.array(word[first])), keys.take(pa.array(row[first])), positions]
    made = pa.RecordBatch.from_arrays(columns, ["lexeme", key, "positions"])
    for at in range(0, len(first), PIECE):
        yield made.slice(at, PIECE)


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each element of the lists the row, and for each row the number of elements."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), lengths


def _postings_schema(df: DataFrame, key: str) -> T.StructType:
    positions = T._parse_datatype_string("positions array<struct<pos:int,label:string>>").fields
    return T.StructType([T.StructField("lexeme", T.StringType()), T.StructField(key, df.schema[key].dataType), *positions])


def postings_of_rows(indexed: DataFrame, key: str = "id") -> DataFrame:
    """The postings of each row, made where the row is, in Arrow batches; those of a batch are in order of lexeme and row. Nothing is shuffled.

    Spark's own sort of an array of more than 8,192 elements takes several threads, and these may not read the same
    Parquet column at once: they fail, wait for each other for ever or give another order.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys, words, pos, labels = batch.columns
            yield from _turned(key, keys, words.flatten(), _rows_of(words)[0], pos.flatten().to_numpy(), labels.flatten())

    parts = [F.col("lexemes")[part].alias(part) for part in ("lexeme", "pos", "label")]
    return indexed.select(key, *parts).mapInArrow(run, _postings_schema(indexed, key))


def postings_of_texts(df: DataFrame, fields: dict[str, str], *, stemmed: bool = False, key: str = "id") -> DataFrame:
    """As ``postings_of_rows`` of ``with_index``, from the words alone: their positions and labels are made beside the sort."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys, *lists = batch.columns
            start, rows, places = np.ones(len(keys), np.int64), [], []
            for words in lists:
                row, lengths = _rows_of(words)
                rows.append(row)
                # the first of a row is at the row's start
                places.append(np.arange(len(row)) + np.repeat(start - np.cumsum(lengths) + lengths, lengths))
                start = start + lengths + 1
            labels = pa.array(list(fields.values()), pa.string()).take(pa.array(np.repeat(np.arange(len(lists)), [len(r) for r in rows])))
            yield from _turned(key, keys, pa.concat_arrays([(stem_lists(x) if stemmed else x).flatten() for x in lists]), np.concatenate(rows), np.concatenate(places), labels)

    words = [words_of(c).alias(f"__words_{i}") for i, c in enumerate(fields)]
    return df.select(key, *words).mapInArrow(run, _postings_schema(df, key))


def postings(indexed: DataFrame, key: str = "id") -> DataFrame:
    """The index turned round: (lexeme, id, positions), for stores that are read by lexeme. Only rows that share an id are brought together."""
    again = stash(indexed.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")), "again")
    if again.isEmpty():
        return postings_of_rows(indexed, key)
    shared = F.col(key).eqNullSafe(F.col("again"))
    united = postings_of_rows(indexed.join(again, shared, "left_semi"), key).groupBy("lexeme", key).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return postings_of_rows(indexed.join(again, shared, "left_anti"), key).unionByName(united)


def stored_index(df: DataFrame, fields: dict[str, str], *, stemmed: bool = False, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """OP-X1 at write time: (rows with their lexemes, postings in order of lexeme), both written, so that a search reads no text and of the postings only its words'."""
    indexed = stash(with_index(df, fields, stemmed=stemmed), "index")
    return indexed, stash(postings(indexed, key).repartitionByRange("lexeme", key).sortWithinPartitions("lexeme", key), "postings")


def matching_ids(stored: DataFrame, terms: list[Term], *, stemmed: bool = False, key: str = "id") -> DataFrame:
    """The ids that all ``terms`` hold for, from the postings of their words; one term at least must ask for something."""
    form = stem if stemmed else str
    options = [[[form(w) for w in o] for o in t.options] for t in terms]
    words = sorted({w for each in options for o in each for w in o})
    at = {w: f"__at_{i}" for i, w in enumerate(words)}
    places = [F.flatten(F.collect_list(F.when(F.col("lexeme") == w, F.transform("positions", lambda p: p["pos"])))).alias(at[w]) for w in words]
    rows = stored.where(F.col("lexeme").isin(words)).groupBy(key).agg(*places)

    def sequence(o: list[str]) -> Column:
        """The words stand side by side somewhere."""
        return F.exists(at[o[0]], lambda p: reduce(lambda a, b: a & b, [F.array_contains(at[w], p + i) for i, w in enumerate(o)]))

    def holds(term: Term, each: list[list[str]]) -> Column:
        found = reduce(lambda a, b: a | b, [sequence(o) if len(o) > 1 else F.size(at[o[0]]) > 0 for o in each])
        return ~found if term.negated else found

    return rows.where(reduce(lambda a, b: a & b, [holds(t, each) for t, each in zip(terms, options, strict=True)])).select(key)


def term_matches(term: Term, words: Column, stemmed: bool = False) -> Column:
    """A term in an array of words in order: single words by membership, sequences in the joined text."""
    form = stem if stemmed else str
    single = [form(o[0]) for o in term.options if len(o) == 1]
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    tests = [F.arrays_overlap(words, F.array(*map(F.lit, single)))] if single else []
    tests += [F.contains(joined, F.lit(" " + " ".join(map(form, o)) + " ")) for o in term.options if len(o) > 1]
    hit = F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
    return ~hit if term.negated else hit


def matches(terms: list[Term], words: Column, stemmed: bool = False) -> Column:
    """OP-X2, expanded path: all terms."""
    return reduce(lambda a, b: a & b, [term_matches(t, words, stemmed) for t in terms], F.lit(True))


def matches_literal(query: str, words: Column, stemmed: bool = False) -> Column:
    """OP-X2 plain path, OP-X14: the query as typed, "or" between alternatives, no synonyms."""
    return reduce(lambda a, b: a | b, [matches(c, words, stemmed) for c in literal(query)], F.lit(False))


def covers(groups: list[set[str]], lexemes: Iterable[dict], labels: dict[str, float]) -> float:
    """Cover density: each shortest stretch that holds every group counts the harmonic mean of its label weights over one plus its gaps."""
    hits = sorted((x["pos"], labels.get(x["label"], 0.0), frozenset(i for i, g in enumerate(groups) if x["lexeme"] in g)) for x in lexemes)
    hits = [h for h in hits if h[2] and h[1] > 0]
    total, lo = 0.0, 0
    have = [0] * len(groups)
    for hi, (_, _, kinds) in enumerate(hits):
        for k in kinds:
            have[k] += 1
        if not all(have):
            continue
        while all(have[k] > 1 for k in hits[lo][2]):
            for k in hits[lo][2]:
                have[k] -= 1
            lo += 1
        part = hits[lo : hi + 1]
        gaps = part[-1][0] - part[0][0] - (len(part) - 1)
        total += len(part) / sum(1 / w for _, w, _ in part) / (1 + max(0, gaps))
        for k in hits[lo][2]:
            have[k] -= 1
        lo += 1
    return total


def keyword_rank(query: str, lexemes: str = "lexemes", *, labels: dict[str, float] | None = None, stemmed: bool = False) -> Column:
    """OP-X6. Cover density of the literal query in 0..1 (rank over one plus rank); Arrow batches, on matching rows."""
    form = stem if stemmed else str
    groups = [{form(w)} for c in literal(query) for t in c if not t.negated for o in t.options for w in o]
    table = labels or LABELS

    def run(column: pa.Array) -> pa.Array:
        # rows with the same words in the same places have one rank
        hits = column.fill_null("[]").dictionary_encode()
        ranks = [covers(groups, json.loads(h), table) if groups else 0.0 for h in hits.dictionary.to_pylist()]
        return pa.array([r / (1 + r) for r in ranks], pa.float64()).take(hits.indices)

    # only the query's own words leave the JVM
    asked = sorted(set().union(*groups))
    return F.arrow_udf(run, T.DoubleType())(F.to_json(F.filter(lexemes, lambda x: x["lexeme"].isin(asked))))


def urgency(closing_at, as_of) -> Column:
    """OP-X8. No deadline 0.15, closed 0, within twelve hours 0.35, within thirty days a ramp, else 0.1."""
    c = F.col(closing_at) if isinstance(closing_at, str) else closing_at
    seconds = (F.unix_micros(c.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / F.lit(1e6)
    return (
        F.when(c.isNull(), NO_DEADLINE).when(seconds <= 0, CLOSED).when(seconds < FLOOR_HOURS * 3600, TOO_SOON)
        .when(seconds < HORIZON_DAYS * 86400, 1.0 - seconds / F.lit(HORIZON_DAYS * 86400.0)).otherwise(FAR)
    )


def authority(score) -> Column:
    """OP-X9."""
    c = F.col(score) if isinstance(score, str) else score
    return F.coalesce(c, F.lit(50)).cast("double") / 100.0


@dataclass(frozen=True)
class Weights:
    """OP-X7. Shares of the signals, made to sum to one and rounded to four places."""

    keyword: float = KEYWORD
    authority: float = AUTHORITY
    urgency: float = URGENCY
    vector: float = 0.0

    def shares(self) -> tuple[float, ...]:
        parts = (self.keyword, self.authority, self.urgency, self.vector)
        total = sum(parts)
        return tuple(round(p / total, 4) for p in parts) if total > 0 else Weights().shares()


def composite_score(keyword: Column, authority_: Column, urgency_: Column, similarity: Column | None = None, weights: Weights | None = None) -> Column:
    """OP-X7, OP-X12. Without a vector its term is left out and the others share its weight."""
    w = (weights or Weights(vector=VECTOR if similarity is not None else 0.0)).shares()
    score = w[0] * keyword + w[1] * authority_ + w[2] * urgency_
    return score + w[3] * similarity if similarity is not None and w[3] else score


def browse_order() -> list[Column]:
    """OP-S2. A total order: closing first, authority, latest published, id."""
    return [F.col("closing_at").asc_nulls_last(), authority("authority_score").desc(), F.col("published_at").desc_nulls_last(), F.col("id").asc()]


def filters(*, province=None, status=None, compulsory=None, buyer=None, closing_within_days=None, as_of: Column | None = None) -> Column:
    """OP-P4 to OP-P7. Values are checked before anything runs; null flags never equal false."""
    tests = [F.lit(True)]
    if province is not None:
        if province not in PROVINCES:
            raise ValueError(f"no such province: {province}")
        tests.append(F.col("province") == province)
    if status is not None:
        if status.upper() not in STATUSES:
            raise ValueError(f"no such status: {status}")
        tests.append(F.col("status") == status.upper())
    if compulsory is not None:
        tests.append(F.col("compulsory_briefing") == compulsory)
    if buyer is not None:
        tests.append(F.col("buyer_name").ilike(f"%{buyer}%"))
    if closing_within_days is not None:
        tests.append(F.col("closing_at").between(as_of, as_of + F.make_dt_interval(F.lit(closing_within_days))))
    return reduce(lambda a, b: a & b, tests)


def match_relation(indexed: DataFrame, query: str | None, *, stemmed: bool = False, synonyms: dict | None = None, stored: DataFrame | None = None, **conditions) -> tuple[DataFrame, list[Term]]:
    """OP-X11, OP-P8, OP-A11. The rows that a search finds, and its terms; a blank or noise query finds all rows.

    Counts are taken over this relation: it has no rank, vector or highlight. With the ``stored`` postings the
    rows are looked up; a query that only excludes has to read all rows' lexemes.
    """
    terms = expand(query, synonyms)
    found = indexed.where(filters(**conditions))
    if terms and stored is not None and not all(t.negated for t in terms):
        found = found.join(matching_ids(stored, terms, stemmed=stemmed), "id", "left_semi")
    elif terms:
        words = F.transform("lexemes", lambda x: x["lexeme"])
        found = found.where(matches(terms, words, stemmed))
    return found, terms


#: The columns of a search result.
PROJECTION = (
    "id", "tender_number", "title", "description", "province", "status", "published_at", "closing_at", "briefing_at", "compulsory_briefing",
    "value_estimated", "currency", "original_url", "source_urls", "field_provenance", "authority_score", "buyer_name",
)


def projected(tenders: DataFrame, organisations: DataFrame) -> DataFrame:
    """OP-P1, SRC-18. The columns of a search result, the buyer by the name of its organisation."""
    named = tenders.drop("buyer_name").join(organisations.select(F.col("id").alias("buyer_org_id"), F.col("name").alias("buyer_name")), "buyer_org_id", "left")
    return named.select(*PROJECTION)


def search(indexed: DataFrame, query: str | None, as_of: Column, *, limit: int = 20, offset: int = 0, vector=None, embeddings: DataFrame | None = None, model: str | None = None, stemmed: bool = False, synonyms: dict | None = None, stored: DataFrame | None = None, **conditions) -> DataFrame:
    """OP-X11, OP-X12. One page of results, best first; ``score`` is null when browsing.

    The highlight is put on afterwards, by ``with_headline`` on this page. Embeddings are joined for their
    model only, so several models do not repeat rows.
    """
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset not negative")
    found, terms = match_relation(indexed, query, stemmed=stemmed, synonyms=synonyms, stored=stored, as_of=as_of, **conditions)
    if not terms:
        return found.withColumn("score", F.lit(None).cast("double")).orderBy(*browse_order()).offset(offset).limit(limit)
    similarity = None
    if vector is not None and embeddings is not None:
        own = embeddings.where(F.col("model") == model).select(F.col("tender_id").alias("id"), "embedding")
        found = found.join(own, "id", "left")
        similarity = F.coalesce(cosine_at_least_zero("embedding", F.array(*[F.lit(float(x)) for x in vector])), F.lit(0.0))
    score = composite_score(keyword_rank(query, stemmed=stemmed), authority("authority_score"), urgency("closing_at", as_of), similarity)
    ranked = found.withColumn("score", score).drop("embedding")
    return ranked.orderBy(F.col("score").desc(), F.col("closing_at").asc_nulls_last(), F.col("id")).offset(offset).limit(limit)


def headline(text, terms: list[Term], *, whole: bool = False, stemmed: bool = True) -> Column:
    """OP-X10. The text, escaped, with matching words marked; unless ``whole``, the stretch of words with most matches. Null without a match."""
    form = stem if stemmed else str
    wanted = {form(w) for t in terms if not t.negated for o in t.options for w in o}

    def mark(t: str | None) -> str | None:
        pieces = re.findall(r"\w+|\W+", t or "")
        at = [i for i, p in enumerate(pieces) if p[0].isalnum() or p[0] == "_"]
        hits = [form(pieces[i].lower()) in wanted for i in at]
        if not any(hits):
            return None
        lo, hi = 0, len(at)
        if not whole and len(at) > SNIPPET_WORDS:
            sums = [sum(hits[:SNIPPET_WORDS])]
            for k in range(1, len(at) - SNIPPET_WORDS + 1):
                sums.append(sums[-1] + hits[k + SNIPPET_WORDS - 1] - hits[k - 1])
            lo = sums.index(max(sums))
            hi = lo + SNIPPET_WORDS
        marked = {i for i, h in zip(at[lo:hi], hits[lo:hi], strict=True) if h}
        first, last = (0, len(pieces)) if hi - lo == len(at) else (at[lo], at[hi - 1] + 1)
        escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return "".join(MARK + escape(p) + END_MARK if i in marked else escape(p) for i, p in enumerate(pieces[first:last], first))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([mark(x.as_py()) for x in column], pa.string())

    c = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(run, T.StringType())(c)


def with_headline(page: DataFrame, query: str, title: str = "title", body: str = "description", synonyms: dict | None = None, stemmed: bool = True) -> DataFrame:
    """Highlights for the rows of one page."""
    terms = expand(query, synonyms)
    if not terms:
        none = F.lit(None).cast("string")
        return page.withColumns({"title_highlight": none, "snippet": none})
    whole = F.coalesce(headline(title, terms, whole=True, stemmed=stemmed), html_escape(title))
    return page.withColumns({"title_highlight": whole, "snippet": headline(body, terms, stemmed=stemmed)})


def embed_pending(tenders: DataFrame, embeddings: DataFrame, model: str, embed, dims: int, limit: int = 100) -> DataFrame:
    """OP-X13, OP-J9, OP-S7. Embeddings for the tenders that lack one of the model, those that close first, by ``embed(list of texts)``."""
    from procurelake.functions.text import embedding_text

    have = embeddings.where(F.col("model") == model).select(F.col("tender_id").alias("id"))
    todo = tenders.join(have, "id", "left_anti").orderBy(F.col("closing_at").asc_nulls_last(), "id").limit(limit)
    texts = todo.select(F.col("id").alias("tender_id"), embedding_text("title", "buyer_name", "description").alias("text"))

    def run(batches):
        for b in batches:
            vectors = embed(b.column(1).to_pylist())
            if any(len(v) != dims for v in vectors):
                raise ValueError(f"an embedding needs {dims} numbers")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["tender_id", "embedding"])

    made = texts.mapInArrow(run, T.StructType([texts.schema["tender_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    return made.withColumn("model", F.lit(model))
