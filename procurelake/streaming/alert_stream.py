"""Alerts on a stream of tenders: stored clauses, an equi-join on what they ask for, and what was sent in state (OP-J17, SNK-10, SNK-11, 2.14)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from procurelake.operators.stores import History
from procurelake.plans.alerts import ALERTABLE, digests, keyword_clauses, valid_alert, verified_closing_within
from procurelake.shared import apart, stash

#: What every tender has: the key of clauses that only exclude.
ANY = "*"
EVENTS = "alert_id long, tender_id long, closing_at timestamp, created_at timestamp"
NO_TERMS = "array<struct<words:array<string>,negated:boolean>>"


def stored_clauses(alerts: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(key, alert_id, terms, provinces, categories, closing_within_days): each active alert under keys of which a match has one.

    A clause of keywords lies under one of the words it asks for: the rarest by ``frequencies(lexeme, n)``, or
    else the longest; one that only excludes under the key of all tenders. An alert without keywords lies
    under each of its provinces, or else each of its categories. Alerts that ask for nothing, and inactive ones, have no key.
    """
    live = alerts.where(F.col("active") & valid_alert("keywords", "provinces", "categories"))
    asked = ["alert_id", "provinces", "categories", "closing_within_days"]
    clauses = keyword_clauses(live)
    words = clauses.select("keywords", "clause", F.explode(F.filter("terms", lambda t: ~t["negated"])).alias("t")).select("keywords", "clause", F.explode("t.words").alias("lexeme"))
    known = words.join(apart(frequencies.select("lexeme", "n"), "lexeme"), "lexeme", "left") if frequencies is not None else words.withColumn("n", F.lit(None).cast("long"))
    lead = known.groupBy("keywords", "clause").agg(F.min_by("lexeme", F.struct(F.coalesce("n", F.lit(0)), -F.length("lexeme"), "lexeme")).alias("lead"))
    keyed = clauses.join(lead, ["keywords", "clause"], "left").select("keywords", "terms", F.coalesce(F.concat(F.lit("w:"), "lead"), F.lit(ANY)).alias("key"))
    worded = F.trim(F.coalesce("keywords", F.lit(""))) != ""
    by_words = live.where(worded).join(keyed, "keywords").select("key", "terms", *asked)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    listed = lambda mark, c: F.transform(F.array_distinct(F.array_compact(c)), lambda x: F.concat(F.lit(mark), x))
    keys = F.when(some("provinces"), listed("p:", F.col("provinces"))).otherwise(listed("c:", F.col("categories")))
    return by_words.unionByName(live.where(~worded).select(F.explode(keys).alias("key"), F.array().cast(NO_TERMS).alias("terms"), *asked))


def matched(tenders: DataFrame, clauses: DataFrame, as_of: Column) -> DataFrame:
    """(alert_id, tender_id, closing_at, created_at) of the tenders, a stream or a table, that meet a clause; a pair comes once for each clause met."""
    words = F.transform("lexemes", lambda x: x["lexeme"])
    open_ = tenders.where(F.col("status").isin(*ALERTABLE)).select(
        F.col("id").alias("tender_id"), "province", F.col("categories").alias("own_categories"), "closing_at", "created_at", "field_provenance",
        F.array_distinct(words).alias("bag"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("joined"),
    )
    marked = lambda mark, c: F.transform(F.array_compact(c), lambda x: F.concat(F.lit(mark), x))
    none = F.array().cast("array<string>")
    keys = F.concat(F.array(F.lit(ANY)), marked("w:", F.coalesce("bag", none)), marked("p:", F.array("province")), marked("c:", F.array_distinct(F.coalesce("own_categories", none))))
    met = open_.withColumn("key", F.explode(keys)).join(clauses, "key")
    has = lambda t: F.when(F.size(t["words"]) == 1, F.array_contains("bag", t["words"][0])).otherwise(F.contains("joined", F.concat(F.lit(" "), F.array_join(t["words"], " "), F.lit(" "))))
    in_province = (F.coalesce(F.size("provinces"), F.lit(0)) <= 0) | F.array_contains("provinces", F.col("province"))
    in_category = (F.coalesce(F.size("categories"), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap("categories", "own_categories"), F.lit(False))
    in_time = F.col("closing_within_days").isNull() | F.coalesce(verified_closing_within(F.col("closing_within_days"), as_of), F.lit(False))
    fits = F.coalesce(F.forall("terms", lambda t: F.coalesce(has(t), F.lit(False)) != t["negated"]) & in_province & in_category & in_time, F.lit(False))
    return met.where(fits).select("alert_id", "tender_id", F.col("closing_at").cast("timestamp").alias("closing_at"), F.col("created_at").cast("timestamp").alias("created_at"))


def counts_met(tenders: DataFrame, clauses: DataFrame, as_of: Column) -> DataFrame:
    """(alert_id, n, first_id, last_id): how many tenders of a table, with ids that are not repeated, each alert meets.

    Only an alert with several clauses can meet a tender twice, so only its pairs are made distinct; the others are counted where they are met.
    """
    stored = stash(clauses, "clauses")
    several = stored.groupBy("alert_id").count().where("count > 1").select("alert_id")
    once = matched(tenders, stored.join(several, "alert_id", "left_anti"), as_of).select("alert_id", "tender_id")
    more = matched(tenders, stored.join(several, "alert_id", "left_semi"), as_of).select("alert_id", "tender_id").distinct()
    count = lambda met: met.groupBy("alert_id").agg(F.count("*").alias("n"), F.min("tender_id").alias("first_id"), F.max("tender_id").alias("last_id"))
    return count(once).unionByName(count(more))


class SentOnce(StatefulProcessor):
    """Passes each tender of an alert on once; what was sent is kept in a map by tender."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "tender_id long", "at timestamp")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for tender in initialState["tender_id"].dropna().astype("int64"):
            self.sent.updateValue((int(tender),), (None,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            fresh = []
            for i, tender in enumerate(part["tender_id"]):
                if not self.sent.containsKey((int(tender),)):
                    self.sent.updateValue((int(tender),), (None,))
                    fresh.append(i)
            if fresh:
                yield part.iloc[fresh][["alert_id", "tender_id", "closing_at", "created_at"]]

    def close(self) -> None:
        pass


def alert_events(tenders: DataFrame, clauses: DataFrame, as_of: Column, sent: DataFrame | None = None) -> DataFrame:
    """A stream of (alert_id, tender_id, closing_at, created_at), each pair at most once, from a stream of ``tenders`` (as ``match_alerts`` takes them).

    A tender that comes again, changed or not, is sent to the alerts that did not have it. ``sent(alert_id,
    tender_id)`` is what had been sent before the stream began. Tenders without an id are no tenders. Needs the RocksDB state store.
    """
    pairs = matched(tenders.where("id is not null"), clauses, as_of)
    before = sent.select("alert_id", "tender_id").groupBy("alert_id") if sent is not None else None
    return pairs.groupBy("alert_id").transformWithStateInPandas(SentOnce(), EVENTS, "Append", "None", initialState=before)


def outbox(events: DataFrame, tenders: DataFrame, box: History, checkpoint: str, trigger: dict | None = None):
    """SNK-11. One digest for each alert and batch of ``events``, written to the outbox once for each batch number; ``tenders`` has the titles and dates.

    The lines of a digest are in order of closing date. A batch that is run again writes nothing.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("alert_id").orderBy(F.col("closing_at").asc_nulls_last(), F.col("created_at").desc(), "tender_id")

    def put(batch: DataFrame, n: int) -> None:
        box.append(digests(batch.select("alert_id", "tender_id", F.row_number().over(order).alias("rank")), tenders), n)

    writer = events.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
