"""Upsert with field diffs, version history and change labels (SNK-1 to SNK-7, OP-D3, OP-D4, OP-J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.shared import apart, components, stash

#: The fields whose changes make a version.
TRACKED = (
    "title", "tender_number", "description", "buyer_name", "province", "status",
    "published_at", "closing_at", "briefing_at", "compulsory_briefing", "value_estimated", "currency",
)
CHANGE = "array<struct<field:string,old:string,new:string>>"


def plain(c: Column, kind: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if kind.startswith("timestamp") and kind != "timestamp_ntz" else c.cast("string")


def field_changes(rows: DataFrame, old: str, new: str, fields=TRACKED) -> Column:
    """OP-D3. The fields of the struct ``new`` that have a value and differ from ``old``'s."""
    kinds = dict(rows.select(f"{new}.*").dtypes)
    changes = []
    for f in fields:
        if f in kinds:
            a, b = F.col(f"{old}.{f}"), F.col(f"{new}.{f}")
            changes.append(F.when(b.isNotNull() & ~a.eqNullSafe(b), F.struct(F.lit(f).alias("field"), plain(a, kinds[f]).alias("old"), plain(b, kinds[f]).alias("new"))))
    return F.array_compact(F.array(*changes)).cast(CHANGE)


def change_kind(changes, old_closing, new_closing) -> Column:
    """OP-D4. CANCELLED, RE_ADVERTISED, EXTENDED, SHORTENED or DETAILS_CHANGED; null without changes."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    to = lambda status: F.exists(c(changes), lambda x: (x["field"] == "status") & (x["new"] == status))
    moved = F.exists(c(changes), lambda x: (x["field"] == "closing_at") & x["old"].isNotNull())
    return (
        F.when(F.size(c(changes)) == 0, None)
        .when(to("CANCELLED"), "CANCELLED")
        .when(to("RE_ADVERTISED"), "RE_ADVERTISED")
        .when(moved & (c(new_closing) > c(old_closing)), "EXTENDED")
        .when(moved & (c(new_closing) < c(old_closing)), "SHORTENED")
        .otherwise("DETAILS_CHANGED")
    )


def match_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """OP-J14. ``incoming`` with tender_id: by natural key, else by fingerprint, else null."""
    by_key = existing.where("natural_key is not null").groupBy("natural_key").agg(F.min("tender_id").alias("__by_key"))
    by_print = existing.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("tender_id").alias("__by_print"))
    found = incoming.join(by_key, "natural_key", "left").join(by_print, "fingerprint", "left")
    return found.withColumn("tender_id", F.coalesce("__by_key", "__by_print")).drop("__by_key", "__by_print")


def identities(existing: DataFrame, incoming: DataFrame, order: str = "seen_at") -> DataFrame:
    """OP-J14 for a whole batch: ``incoming``, written, with the tender_id of each arrival, new ones made.

    An arrival that a stored tender has by natural key, else by fingerprint, is that tender. The others are
    identified with each other: arrivals that share a natural key or a fingerprint, directly or through
    others, are one tender: the stored one with the smallest id that any of them matched, or else a new
    one, named by their smallest key and first time. An arrival without either key is a tender of its own
    (equal ones are one). Keys are connected, not arrivals, and only where a fingerprint comes with two
    natural keys does it take the general components; a key that very many arrivals have is one row.
    """
    found = stash(match_existing(incoming, existing), "arrivals")
    # written, since Spark would leave out distinct before a minimum, and minima of strings are taken by sorting all arrivals of a task
    both = stash(found.where("natural_key is not null and fingerprint is not null").select("natural_key", "fingerprint").distinct(), "pairs")
    by_print = stash(both.groupBy("fingerprint").agg(F.min("natural_key").alias("low"), F.max("natural_key").alias("high")), "prints")
    node = F.coalesce(F.concat(F.lit("n:"), "natural_key"), F.concat(F.lit("f:"), "fingerprint"), F.concat(F.lit("r:"), F.sha2(F.to_json(F.struct(*incoming.columns)), 256)))
    if by_print.where("low != high").isEmpty():
        met = found.join(apart(by_print.select("fingerprint", "low"), "fingerprint"), "fingerprint", "left")
        rooted = met.withColumn("__root", F.when(F.col("natural_key").isNull() & F.col("low").isNotNull(), F.concat(F.lit("n:"), "low")).otherwise(node)).drop("low")
    else:
        linked = components(both.select(F.concat(F.lit("n:"), "natural_key").alias("a"), F.concat(F.lit("f:"), "fingerprint").alias("b")), "keys")
        rooted = found.withColumn("__node", node).join(apart(linked.select(F.col("node").alias("__node"), F.col("component").alias("__root")), "__node"), "__node", "left")
        rooted = rooted.withColumn("__root", F.coalesce("__root", "__node")).drop("__node")
    # apart from each other for the same reason: only arrivals that were matched have an id, and times are compared without sorting
    known = rooted.where("tender_id is not null").select("__root", "tender_id").groupBy("__root").agg(F.min("tender_id").alias("__known"))
    heads = rooted.groupBy("__root").agg(F.min(order).alias("__first")).join(known, "__root", "left")
    made = F.sha2(F.concat_ws("|", "__root", F.col("__first").cast("string")), 256)
    return rooted.join(apart(heads, "__root"), "__root").withColumn("tender_id", F.coalesce("tender_id", "__known", made)).drop("__root", "__known", "__first")


#: Lists of which an update keeps all entries, with the part of an entry that tells it from others; columns that the last
#: value given, or the first, decides.
UNITED = {"source_urls": lambda x: x, "documents": lambda x: x["url"], "review_items": lambda x: x["field"]}
LAST_GIVEN, FIRST_GIVEN = ("buyer_org_id",), ("normalized_tender_number", "buyer_key", "categories", "requirements", "ocid", "original_url")


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "seen_at") -> tuple[DataFrame, DataFrame]:
    """SNK-1, SNK-5. (new state, new versions) after folding ``incoming`` into ``existing`` in order of ``order``.

    ``existing`` has tender_id, natural_key, fingerprint, version_no and the tracked fields; ``incoming`` the
    same but tender_id and version_no. A new tender is version 1, CREATED; each arrival that changes a
    tracked field is one version more. A field that an arrival leaves out keeps its value. Several arrivals
    of one tender in a batch follow one another (see ``identities``); ties in ``order`` are broken by the fields themselves.

    What is not tracked is folded too, where ``incoming`` has it: source urls, documents (by url) and review
    items (by field) are united in the order in which they came, the authority score is the greatest, the
    organisation the last given, others the first. An arrival takes effect if it creates, changes a tracked
    field or brings a new url; the fingerprint and the provenance are those of the last that did, and the
    documents and review items of one that did not are not taken. An empty batch changes nothing; columns of neither kind are not kept.
    """
    return fold(existing, identities(existing, incoming, order), order)


def fold(existing: DataFrame, identified: DataFrame, order: str = "seen_at") -> tuple[DataFrame, DataFrame]:
    """``upsert`` of arrivals that have their tender_id already."""
    fields = [f for f in TRACKED if f in identified.columns]
    more = [c for c in (*UNITED, "authority_score", "field_provenance", *LAST_GIVEN, *FIRST_GIVEN) if c in identified.columns]
    kinds = dict(identified.dtypes)
    arrivals = identified.withColumn("__at", F.struct(F.col(order), F.to_json(F.struct(*fields)), F.col("fingerprint")))
    key = Window.partitionBy("tender_id")
    held = [F.col(c) if c in existing.columns else F.lit(None).cast(kinds[c]).alias(c) for c in more]
    old = existing.select("tender_id", "natural_key", "fingerprint", "version_no", *[F.col(f).alias(f) for f in fields], *held)
    first = old.select("*", F.lit(None).cast(arrivals.schema["__at"].dataType).alias("__at"), F.lit(True).alias("__stored"))
    rest = arrivals.select("tender_id", "natural_key", "fingerprint", F.lit(None).cast("int").alias("version_no"), *fields, *more, "__at", F.lit(False).alias("__stored"))
    run = key.orderBy(F.col("__stored").desc(), "__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = key.orderBy(F.col("__stored").desc(), "__at").rowsBetween(Window.unboundedPreceding, -1)
    chain = first.unionByName(rest)
    # the state after each arrival: the last value given of every field
    states = chain.select(
        "tender_id", "__stored", "natural_key", "fingerprint", *more,
        F.coalesce(F.first("version_no", True).over(run), F.lit(0)).alias("__base"),
        F.struct(*[F.last(f, True).over(run).alias(f) for f in fields]).alias("new"),
        F.struct(*[F.last(f, True).over(before).alias(f) for f in fields]).alias("old"),
        F.row_number().over(key.orderBy(F.col("__stored").desc(), "__at")).alias("__k"),
    )
    created = ~F.col("__stored") & (F.col("__k") == 1)
    diffs = states.withColumn("changes", field_changes(states, "old", "new", fields))
    changed = diffs.withColumn("__new", F.when(created, F.lit(1)).when(~F.col("__stored") & (F.size("changes") > 0), F.lit(1)).otherwise(0))
    # while the arrivals of a tender still lie together
    steps = changed.withColumn("version_no", (F.col("__base") + F.sum("__new").over(key.orderBy("__k"))).cast("int"))
    if "source_urls" in more:
        steps = stash(steps, "steps")
        each = steps.select("tender_id", "__k", F.explode("source_urls").alias("url"))
        bring = each.groupBy("tender_id", "url").agg(F.min("__k").alias("__k")).select("tender_id", "__k").distinct().withColumn("__url", F.lit(True))
        steps = steps.join(bring, ["tender_id", "__k"], "left")
    takes = F.col("__stored") | (F.col("__new") == 1) | (F.coalesce("__url", F.lit(False)) if "source_urls" in more else F.lit(False))
    steps = stash(steps.withColumn("__takes", takes), "steps")
    versions = steps.where("__new = 1").select(
        "tender_id", "version_no", F.when(created, F.lit("CREATED")).otherwise(change_kind("changes", "old.closing_at", "new.closing_at") if "closing_at" in fields else F.lit("DETAILS_CHANGED")).alias("kind"),
        F.when(created, F.array().cast(CHANGE)).otherwise(F.col("changes")).alias("changes"),
    )
    given = lambda c: F.col("__takes") & F.col(c).isNotNull()
    last, head = (lambda c: F.max_by(c, F.when(given(c), F.col("__k"))).alias(c)), (lambda c: F.min_by(c, F.when(given(c), F.col("__k"))).alias(c))
    folded = [F.max(F.when(F.col("__takes"), F.col(c))).alias(c) if c == "authority_score" else head(c) if c in FIRST_GIVEN else last(c) for c in more if c not in UNITED]
    state = steps.groupBy("tender_id").agg(F.min_by("natural_key", F.when(F.col("natural_key").isNotNull(), F.col("__k"))).alias("natural_key"), last("fingerprint"), F.max("version_no").alias("version_no"), F.max_by("new", "__k").alias("new"), *folded)
    state = state.select("tender_id", "natural_key", "fingerprint", "version_no", "new.*", *[c for c in more if c not in UNITED])
    for column in (c for c in UNITED if c in more):
        entries = steps.where("__takes").select("tender_id", "__k", F.posexplode(column).alias("i", "x")).withColumn("m", F.struct("__k", "i", "x"))
        one = entries.groupBy("tender_id", UNITED[column](F.col("x")).alias("by")).agg(F.min("m").alias("m"))
        listed = one.groupBy("tender_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]).alias(column))
        state = state.join(listed, "tender_id", "left").withColumn(column, F.coalesce(column, F.array().cast(kinds[column])))
    return state, versions


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """SNK-2, 4, 6, 7, 10, 15. The incoming rows whose key is new, one per key (the first by ``order``, else any equal one).

    As under a unique index, a key with a null matches nothing and repeats freely.
    """
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    ranked = fresh.where(~none).withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order or F.to_json(F.struct(*incoming.columns)))))
    return ranked.where("__k = 1").drop("__k").unionByName(fresh.where(none))


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SNK-14, SNK-17. The last row of each key by ``order``."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__k = 1").drop("__k")


def resolve_buyers(tenders: DataFrame, aliases: DataFrame, name: str = "buyer_name") -> tuple[DataFrame, DataFrame]:
    """SNK-3, OP-J15. (tenders with buyer_org_id, new organisations for the names that no alias(alias, org_id) knows)."""
    from procurelake.functions.keys import org_key

    keyed = tenders.withColumn("alias", org_key(name))
    found = keyed.join(aliases.select("alias", F.col("org_id").alias("__org")), "alias", "left")
    made = found.where("__org is null and alias != ''").groupBy("alias").agg(F.min(name).alias("name"))
    fresh = made.select(F.sha2("alias", 256).alias("org_id"), "name", "alias", F.lit("PUBLIC_ENTITY").alias("type"))
    resolved = found.withColumn("buyer_org_id", F.coalesce("__org", F.when(F.col("alias") != "", F.sha2("alias", 256)))).drop("__org", "alias")
    return resolved, fresh
