"""Duplicate notices: blocked tests, clusters, merging by authority (OP-D5, OP-D6, OP-J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.functions.keys import SIMILAR_TITLES, word_set
from procurelake.shared import apart, components, stash

#: The fields that a merge decides on.
MERGED = (
    "title", "tender_number", "normalized_tender_number", "buyer_name", "buyer_org_id", "description",
    "province", "published_at", "closing_at", "briefing_at", "compulsory_briefing", "value_estimated",
)


def duplicate_links(tenders: DataFrame, key: str = "id", closing_day: str = "closing_day", threshold: float = SIMILAR_TITLES) -> DataFrame:
    """OP-D6, OP-J16. (a, b): links that connect all duplicates, a the smaller key.

    Duplicates share the fingerprint, or buyer and number, or buyer, closing day and similar titles. The
    first two link every member of a group to its smallest, so a group costs one row per member. For the
    third, tenders of a block with the same title words are linked likewise, and one of each set of words is
    compared over its rarest words, one of which similar titles must share, not with the whole block. The keys
    are written once, and groups and blocks of one tender, which have no links, are left out before anything is joined to them.
    """
    held = stash(tenders.select(key, "fingerprint", "buyer_key", "normalized_tender_number", F.col(closing_day).alias("day"), "title"), "keyed")

    def star(on: list[str], where) -> DataFrame:
        rows = held.where(where).select(*on, key)
        low = rows.groupBy(*on).agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        return rows.join(low.repartition(F.xxhash64(*on, F.lit(1))), on).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))

    known = (F.col("buyer_key") != "") | F.col("buyer_key").isNotNull()
    equal = star(["fingerprint"], F.col("fingerprint").isNotNull())
    numbered = star(["buyer_key", "normalized_tender_number"], known & (F.col("normalized_tender_number") != ""))
    dated = held.where(known & F.col("day").isNotNull()).select("buyer_key", "day", key, "title")
    blocks = dated.groupBy("buyer_key", "day").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = dated.join(blocks.repartition(F.xxhash64("buyer_key", "day", F.lit(1))), ["buyer_key", "day"])
    words = stash(crowded.select("buyer_key", "day", key, F.array_sort(word_set("title")).alias("words")).where(F.size("words") > 0), "words")
    low = words.groupBy("buyer_key", "day", "words").agg(F.min(key).alias("a"))
    same = words.join(low.repartition(F.xxhash64("buyer_key", "day", "words", F.lit(1))), ["buyer_key", "day", "words"]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
    # a pair with similarity t shares a word among the first n - ceil(t n) + 1 of each, words in one fixed order: rarest first
    each = low.select("buyer_key", "day", "a", F.explode("words").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("n"))
    sorted_ = each.join(apart(rarity, "word"), "word").groupBy("buyer_key", "day", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
    heads = sorted_.withColumn("head", F.explode(F.slice("words", F.lit(1), F.size("words") - F.ceil(F.size("words") * threshold).cast("int") + 1)))
    left = heads.select("buyer_key", "day", "head", F.col("a").alias("x"), F.col("words").alias("wx"))
    right = heads.select("buyer_key", "day", "head", F.col("a").alias("y"), F.col("words").alias("wy"))
    sizes = (F.size("wy") >= F.size("wx") * threshold) & (F.size("wx") >= F.size("wy") * threshold)
    met = left.join(right, ["buyer_key", "day", "head"]).where((F.col("x") < F.col("y")) & sizes)
    alike = F.size(F.array_intersect("wx", "wy")) / F.size(F.array_union("wx", "wy")) >= threshold
    similar = met.where(alike).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.unionByName(numbered).unionByName(same).unionByName(similar).distinct()


def clusters(tenders: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Every key with the smallest key of its cluster."""
    found = components(links, "clusters").select(F.col("node").alias(key), F.col("component").alias("cluster"))
    return tenders.select(key).distinct().join(found, key, "left").withColumn("cluster", F.coalesce("cluster", key))


#: The columns that a merge unites.
UNITED = ("source_urls", "documents")


def merge_by_authority(tenders: DataFrame, cluster: str = "cluster", key: str = "id") -> DataFrame:
    """OP-D5. One row per cluster: each field from the record of highest authority that has it, ties to the smaller key.

    ``conflicts`` lists, for fields on which a record disagrees with the winner among those ahead of it,
    winner and loser with their sources. Urls are united in order of authority, documents by their url, and
    review items follow one another; ``field_provenance`` has for each field the entry of the record that gave
    the value, or else of the first that has one. Winners are grouped maxima, and everything that lists is made from small rows
    (conflicts, distinct urls), so a cluster with a third of the rows is no task's window.
    """
    kinds = dict(tenders.dtypes)
    fields = [f for f in MERGED if f in kinds]
    filled = lambda f: F.nullif(F.col(f), F.lit("")) if kinds[f] == "string" else F.col(f)
    # the smaller, the more authority
    rank = F.struct((-F.coalesce("authority_score", F.lit(-1))).alias("authority"), F.col(key).alias("k"))
    ranked = tenders.withColumn("__rank", rank)
    first = lambda value, there: F.min(F.when(there, F.struct("__rank", F.col("source_id").alias("source"), value.alias("value"))))
    heads = [first(filled(f), filled(f).isNotNull()).alias(f"__w_{f}") for f in fields]
    best = ranked.groupBy(cluster).agg(F.min_by(key, "__rank").alias(key), F.max("authority_score").alias("authority_score"), F.min_by("source_id", "__rank").alias("source_id"), F.count("*").alias("members"), *heads)
    best = stash(best, "merged")
    out = best.select(cluster, key, "authority_score", "source_id", "members", *[F.col(f"__w_{f}.value").alias(f) for f in fields])

    # one row for each record and field that differs from the winner, which is ahead of it
    winners = best.select(cluster, *[f"__w_{f}" for f in fields])
    both = ranked.select(cluster, "__rank", "source_id", *[filled(f).alias(f) for f in fields]).join(apart(winners, cluster), cluster)
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"__w_{f}.source").alias("winner_source"), F.col(f"__w_{f}.value").cast("string").alias("winner_value"), F.col("source_id").alias("loser_source"), F.col(f).cast("string").alias("loser_value"))
    differing = F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"__w_{f}.value"), F.struct(F.lit(i).alias("i"), entry(f).alias("entry"))) for i, f in enumerate(fields)]))
    rows = both.select(cluster, "__rank", F.explode(differing).alias("d"))
    listed = rows.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "d.i", "d.entry"))), lambda x: x["entry"]).alias("conflicts"))
    out = out.join(listed, cluster, "left")

    def united(column: str, by) -> DataFrame:
        """The entries of a list column that differ in ``by``, in the order of the first record that has them."""
        each = ranked.select(cluster, F.posexplode(column).alias("i", "x"), "__rank").withColumn("m", F.struct("__rank", "i", "x"))
        one = each.groupBy(cluster, by(F.col("x")).alias("by")).agg(F.min("m").alias("m"))
        return one.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]).alias(column))

    for column in (c for c in UNITED if c in kinds):
        by = (lambda x: x["url"]) if column == "documents" and kinds[column] != "array<string>" else (lambda x: x)
        out = out.join(united(column, by), cluster, "left")
    if "review_items" in kinds:
        out = out.join(united("review_items", lambda x: F.struct("__rank", "i")), cluster, "left")
    if "field_provenance" in kinds:
        givers = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"__w_{f}.__rank"))])
        entries = ranked.join(apart(winners, cluster), cluster).select(cluster, "__rank", givers.alias("givers"), F.explode("field_provenance").alias("name", "value"))
        order = F.struct(F.coalesce(F.col("givers")[F.col("name")] != F.col("__rank"), F.lit(True)), "__rank")
        one = entries.groupBy(cluster, "name").agg(F.min_by("value", order).alias("value"))
        out = out.join(one.groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("field_provenance")), cluster, "left")
    nothing = lambda c: F.array().cast(out.schema[c].dataType)
    lists = [c for c in ("conflicts", *UNITED, "review_items") if c in out.columns]
    return out.withColumns({c: F.coalesce(c, nothing(c)) for c in lists})
