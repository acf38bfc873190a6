"""Saved-search alerts, matched set by set (OP-J7, OP-J17, OP-S6, OP-D14, OP-A16, OP-P9 to OP-P11, OP-P20, SNK-10, SNK-11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from procurelake.functions.times import local_label
from procurelake.operators.normalize import VERIFIED
from procurelake.search.parse import literal
from procurelake.shared import apart, stash

#: Statuses that alerts look at, and tenders in one digest.
ALERTABLE = ("NEW", "OPEN", "CLOSING_SOON", "EXTENDED", "RE_ADVERTISED")
PER_ALERT = 25


def valid_alert(keywords, provinces, categories) -> Column:
    """OP-P20. An alert asks for something."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    some = lambda x: F.coalesce(F.size(c(x)) > 0, F.lit(False))
    return (F.trim(F.coalesce(c(keywords), F.lit(""))) != "") | some(provinces) | some(categories)


def verified_closing_within(days, as_of: Column) -> Column:
    """OP-P11. The closing date is verified and lies in the window."""
    confidence = F.coalesce(F.element_at("field_provenance", "closing_at")["confidence"], F.lit(0.0))
    return (confidence >= VERIFIED) & F.col("closing_at").between(as_of, as_of + F.make_dt_interval(days))


CLAUSES = "keywords string, clause int, terms array<struct<words:array<string>,negated:boolean>>"


def keyword_clauses(alerts: DataFrame) -> DataFrame:
    """(keywords, clause, terms) of every distinct keyword query of the alerts, as typed and without synonyms; a query holds where one of its clauses does."""

    def run(batches):
        for batch in batches:
            rows = [(q, n, [{"words": list(t.options[0]), "negated": t.negated} for t in clause]) for q in batch.column(0).to_pylist() for n, clause in enumerate(literal(q))]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    schema = T._parse_datatype_string(CLAUSES)
    arrow = to_arrow_schema(schema)
    return alerts.where(F.trim(F.coalesce("keywords", F.lit(""))) != "").select("keywords").distinct().mapInArrow(run, schema)


def keyword_tests(alerts: DataFrame, tenders: DataFrame) -> DataFrame:
    """(keywords, tender_id) of every distinct keyword query and tender that match.

    A clause looks its rarest word up in the tenders' words, by an equi-join, and its other terms are tested
    on the tenders so found. Only a clause that does nothing but exclude has to see all tenders.
    """
    words = F.transform("lexemes", lambda x: x["lexeme"])
    bags = tenders.select(F.col("id").alias("tender_id"), F.array_distinct(words).alias("bag"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("joined"))
    post = bags.select("tender_id", F.explode("bag").alias("lexeme"))
    clauses = stash(keyword_clauses(alerts), "clauses")
    wanted = clauses.select("keywords", "clause", F.explode(F.filter("terms", lambda t: ~t["negated"])).alias("t")).select("keywords", "clause", F.explode("t.words").alias("lexeme"))
    counts = post.join(wanted.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("n"))
    rarest = wanted.join(apart(counts, "lexeme"), "lexeme", "left").groupBy("keywords", "clause").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "lexeme")).alias("r"))
    led = clauses.join(rarest.where("r.n > 0").select("keywords", "clause", F.col("r.lexeme").alias("lexeme")), ["keywords", "clause"])
    met = led.join(post, "lexeme").join(bags, "tender_id")
    excluding = clauses.where(F.forall("terms", lambda t: t["negated"])).crossJoin(bags)
    has = lambda t: F.when(F.size(t["words"]) == 1, F.array_contains("bag", t["words"][0])).otherwise(F.contains("joined", F.concat(F.lit(" "), F.array_join(t["words"], " "), F.lit(" "))))
    both = met.select("keywords", "tender_id", "terms", "bag", "joined").unionByName(excluding.select("keywords", "tender_id", "terms", "bag", "joined"))
    return both.where(F.forall("terms", lambda t: has(t) != t["negated"])).select("keywords", "tender_id").distinct()


def word_frequencies(tenders: DataFrame) -> DataFrame:
    """(lexeme, n): how many tenders that alerts look at have each word."""
    return tenders.where(F.col("status").isin(*ALERTABLE)).select(F.explode(F.array_distinct(F.transform("lexemes", lambda x: x["lexeme"]))).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("n"))


ASKED = ("keywords", "provinces", "categories", "closing_within_days")


def first_of_each(fit: DataFrame, depths: DataFrame) -> DataFrame:
    """The rows of ``fit(asked, tender_id, closing_at, created_at)`` with their place ``k``, by closing date, newest and id, down to ``depths(asked, depth)`` at least.

    Places are counted by closing day first, those without one by the day they were made, and rows are put in order within their day only, so no group is sorted whole.
    """
    kinds = dict(fit.dtypes)
    day = lambda c: F.floor(F.col(c).cast("long") / 86400) if kinds[c] == "timestamp" else F.col(c).cast("date")
    dated = fit.withColumns({"closing_day": day("closing_at"), "created_day": F.when(F.col("closing_at").isNull(), day("created_at"))})
    days = dated.groupBy("asked", "closing_day", "created_day").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("asked").orderBy(F.col("closing_day").asc_nulls_last(), F.col("created_day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(apart(depths, "asked"), "asked").where("start < depth")
    s = starts.select(F.col("asked").alias("of"), F.col("closing_day").alias("closes"), F.col("created_day").alias("made"), "start")
    near = dated.join(s, (F.col("asked") == F.col("of")) & F.col("closing_day").eqNullSafe(F.col("closes")) & F.col("created_day").eqNullSafe(F.col("made")))
    within = Window.partitionBy("asked", "closing_day", "created_day").orderBy(F.col("closing_at").asc_nulls_last(), F.col("created_at").desc(), "tender_id")
    return near.withColumn("k", F.col("start") + F.row_number().over(within)).select("asked", "tender_id", "closing_at", "created_at", "k")


def match_alerts(alerts: DataFrame, tenders: DataFrame, sent: DataFrame, as_of: Column, limit: int = PER_ALERT) -> DataFrame:
    """OP-J7, OP-J17, OP-S6. (alert_id, tender_id, rank): what each active alert has not been sent, first to close first.

    ``alerts(alert_id, keywords, provinces, categories, closing_within_days, active)``, ``tenders(id, lexemes,
    province, categories, status, closing_at, created_at, field_provenance)``, ``sent(alert_id, tender_id)``.
    A condition that an alert leaves out holds for all tenders. Alerts that ask for the same are matched once;
    each looks no further down than it has been sent, so the rows compared grow with alerts and sent rows, not with their product.
    """
    live = alerts.where(F.col("active") & valid_alert("keywords", "provinces", "categories")).withColumn("asked", F.xxhash64(F.to_json(F.struct(*ASKED))))
    own_sent = sent.select("alert_id", "tender_id").join(live.select("alert_id"), "alert_id", "left_semi").distinct()
    asked = live.select("asked", *ASKED).dropDuplicates(["asked"])
    open_ = tenders.where(F.col("status").isin(*ALERTABLE))
    worded = F.trim(F.coalesce("keywords", F.lit(""))) != ""
    slim = open_.select(F.col("id").alias("tender_id"), "province", F.col("categories").alias("own_categories"), "closing_at", "created_at", "field_provenance")
    by_words = asked.where(worded).join(keyword_tests(asked, open_), "keywords").join(slim, "tender_id")
    # what asks for no words is met by province or category, an equi-join on what it lists
    listed = asked.where(~worded)
    by_province = listed.where(F.size(F.coalesce("provinces", F.array().cast("array<string>"))) > 0).withColumn("province", F.explode(F.array_distinct("provinces"))).join(slim, "province")
    no_province = listed.where(F.coalesce(F.size("provinces"), F.lit(0)) <= 0).withColumn("one", F.explode("categories"))
    by_category = no_province.join(slim.withColumn("one", F.explode(F.array_distinct("own_categories"))), "one").drop("one").dropDuplicates(["asked", "tender_id"])
    cols = [*asked.columns, *slim.columns]
    met = by_words.select(*cols).unionByName(by_province.select(*cols)).unionByName(by_category.select(*cols))
    in_province = (F.coalesce(F.size("provinces"), F.lit(0)) <= 0) | F.array_contains("provinces", F.col("province"))
    in_category = (F.coalesce(F.size("categories"), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap("categories", "own_categories"), F.lit(False))
    in_time = F.col("closing_within_days").isNull() | F.coalesce(verified_closing_within(F.col("closing_within_days"), as_of), F.lit(False))
    order = [F.col("closing_at").asc_nulls_last(), F.col("created_at").desc(), F.col("tender_id")]
    fit = met.where(F.coalesce(in_province, F.lit(False)) & in_category & in_time).select("asked", "tender_id", "closing_at", "created_at")
    deep = live.join(apart(own_sent.groupBy("alert_id").count(), "alert_id"), "alert_id", "left").select("alert_id", "asked", (F.coalesce("count", F.lit(0)) + limit).alias("depth"))
    first = first_of_each(stash(fit, "fit"), deep.groupBy("asked").agg(F.max("depth").alias("depth")))
    # places are dealt by their number of binary digits, so an alert meets less than twice the places that it looks at
    digits = lambda c: F.length(F.bin(c))
    levels = deep.withColumn("level", F.explode(F.sequence(F.lit(1), digits("depth"))))
    fresh = levels.join(first.withColumn("level", digits("k")), ["asked", "level"]).where("k <= depth").join(own_sent, ["alert_id", "tender_id"], "left_anti")
    ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("alert_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).select("alert_id", "tender_id", "rank")


def digests(matched: DataFrame, tenders: DataFrame) -> DataFrame:
    """OP-D14. (alert_id, n, body): one text per alert; unverified closing dates are withheld."""
    confidence = F.coalesce(F.element_at("field_provenance", "closing_at")["confidence"], F.lit(0.0))
    when = F.when(F.col("closing_at").isNull() | (confidence < VERIFIED), F.lit("closing date unverified - check at source")).otherwise(F.concat(F.lit("closes "), local_label("closing_at")))
    line = F.concat(F.col("title"), F.lit(" | "), when)
    rows = matched.join(tenders.select(F.col("id").alias("tender_id"), "title", "closing_at", "field_provenance"), "tender_id").select("alert_id", "rank", line.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("alert_id").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"))


#: The wording of a digest.
DIGEST = {
    "subject": "{}: %d new tender%s for “%s”", "intro": "%d new tender%s your alert (%s):", "label": "your saved search", "buyer": "Unknown buyer",
    "unverified": "  Closing date UNVERIFIED — verify at source before relying on it", "briefing": "  ⚠ COMPULSORY briefing — missing it disqualifies your bid", "undated": "no date published",
    "about": "{} aggregates official sources and always links to the original.", "licence": "eTender OCDS data © National Treasury, CC BY 4.0.",
}


def render_digests(matched: DataFrame, tenders: DataFrame, alerts: DataFrame, brand: str, base_url: str = "") -> DataFrame:
    """OP-D14. (alert_id, subject, body) for each alert with matches.

    ``tenders(id, title, tender_number, buyer_name, province, closing_at, field_provenance, compulsory_briefing,
    original_url)``, ``alerts(alert_id, keywords, user_name)``. A closing date below the threshold is withheld,
    a compulsory briefing is warned of, and every tender has a link if one is known. ``brand`` signs the text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = lambda c: text(c) != ""
    verified = F.coalesce(F.element_at("field_provenance", "closing_at")["confidence"], F.lit(0.0)) >= VERIFIED
    link = F.concat(F.lit(f"{base_url}/tender/"), F.col("id").cast("string")) if base_url else text("original_url")
    lines = F.array(
        F.concat(F.lit("• "), F.when(some("tender_number"), F.concat("tender_number", F.lit(" — "))).otherwise(""), text("title")),
        F.concat(F.lit("  "), F.when(some("buyer_name"), F.col("buyer_name")).otherwise(DIGEST["buyer"]), F.when(some("province"), F.concat(F.lit(" · "), F.col("province"))).otherwise("")),
        F.when(verified, F.concat(F.lit("  Closes: "), F.coalesce(local_label("closing_at"), F.lit(DIGEST["undated"])))).otherwise(DIGEST["unverified"]),
        F.when(F.col("compulsory_briefing"), F.lit(DIGEST["briefing"])),
        F.when(link != "", F.concat(F.lit("  "), link)),
        F.lit(""),
    )
    rows = matched.join(tenders.select(F.col("id").alias("tender_id"), F.array_join(lines, "\n").alias("entry")), "tender_id")
    listed = rows.groupBy("alert_id").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    named = listed.join(alerts.select("alert_id", "keywords", "user_name"), "alert_id")
    trimmed = F.trim(text("keywords"))
    label = F.when(trimmed != "", trimmed).otherwise(DIGEST["label"])
    foot = [F.lit("—"), F.lit(DIGEST["about"].format(brand)), F.lit(DIGEST["licence"]), F.lit("Manage your alerts: " + (f"{base_url}/alerts" if base_url else f"{brand} → Alerts"))]
    hello = F.concat(F.lit("Hi"), F.when(some("user_name"), F.concat(F.lit(" "), F.col("user_name"))).otherwise(""), F.lit(","))
    intro = F.format_string(DIGEST["intro"], "n", F.when(F.col("n") == 1, " matches").otherwise("s match"), label)
    return named.select(
        "alert_id", F.format_string(DIGEST["subject"].format(brand), "n", F.when(F.col("n") == 1, "").otherwise("s"), label).alias("subject"),
        F.concat_ws("\n", hello, F.lit(""), intro, F.lit(""), F.col("entries"), *foot).alias("body"),
    )


def alert_totals(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """OP-J11. Each alert with its events counted and the last one's time."""
    sums = events.groupBy("alert_id").agg(F.count("*").alias("sent"), F.max("sent_at").alias("last_sent"))
    return alerts.join(sums, "alert_id", "left").withColumn("sent", F.coalesce("sent", F.lit(0)))


def run_summary(matched: DataFrame) -> DataFrame:
    """OP-A16."""
    return matched.agg(F.count_distinct("alert_id").alias("alerts_matched"), F.count("*").alias("tenders_matched"))
