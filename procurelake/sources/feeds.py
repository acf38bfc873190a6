"""Feeds, sitemaps and posts as notices (SRC-6 to SRC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.times import SAST, no_sentinel, parse_iso
from procurelake.schemas import notice


def as_notices(rows: DataFrame) -> DataFrame:
    """The rows with every column of a notice, absent ones null or empty."""
    empty = {T.ArrayType: lambda f: F.array().cast(f.dataType), T.MapType: lambda f: F.create_map().cast(f.dataType)}
    made = [F.col(f.name) if f.name in rows.columns else empty.get(type(f.dataType), lambda f: F.lit(None))(f).cast(f.dataType).alias(f.name) for f in notice().fields]
    return rows.select(*made)


#: Zones that mail dates name, and the two-digit year from which the century is the last.
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
LAST_CENTURY = 69
MAIL_DATE = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+(\S+))?"


def feed_date(text) -> Column:
    """SRC-7. Mail-style dates first (the name of the day is skipped, zones may be named, years have two digits or four), then ISO; without a zone the time is local."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    part = lambda i: F.regexp_extract(c, MAIL_DATE, i)
    year = part(3).try_cast("int")
    full = F.when(F.length(part(3)) > 2, year).when(year < LAST_CENTURY, year + 2000).otherwise(year + 1900)
    names = F.create_map(*[F.lit(x) for kv in MAIL_ZONES.items() for x in kv])
    said = F.upper(part(7))
    # a zone of minus zero says that none is known
    zone = F.when(said.rlike(r"^[+-]\d{4}$") & (said != "-0000"), said).otherwise(F.coalesce(F.try_element_at(names, said), F.lit(SAST.replace(":", ""))))
    written = F.concat_ws(" ", part(1), F.initcap(part(2)), F.lpad(full.cast("string"), 4, "0"), F.concat_ws(":", part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))), zone)
    mail = F.when(c.rlike(MAIL_DATE), F.try_to_timestamp(written, F.lit("d MMM yyyy H:mm:ss Z")))
    return no_sentinel(F.coalesce(mail, parse_iso(c, SAST)))


def plain_text(xml: Column) -> Column:
    """The text of an element: sections unwrapped, entities read, white space around it removed; null if empty."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"^\s+|\s+$", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.nullif(bare, F.lit(""))


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """SRC-6. RSS items and Atom entries of ``feeds(source_id, url, xml)`` as notices; without a title or link there is none.

    Entries are cut out by their tags, so that of a feed that is broken off those before the break are read,
    and a text that is no feed has none; see ``for_triage``.
    """
    out = None
    for kind, names in (("item", ("title", "link", "description", "pubDate")), ("entry", ("title", "link", None, "updated"))):
        blocks = F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<(?:\w+:)?{kind}\b.*?</(?:\w+:)?{kind}>"), F.lit(0))
        rows = feeds.select("source_id", F.explode(blocks).alias("block"))
        child = lambda name: plain_text(F.regexp_extract("block", rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1))
        href = plain_text(F.regexp_extract("block", r"<(?:\w+:)?link\b[^>]*?href\s*=\s*[\"']([^\"']+)", 1))
        part = rows.select(
            "source_id",
            (child("link") if kind == "item" else href).alias("source_url"),
            child(names[0]).alias("title"),
            (child(names[2]) if names[2] else F.lit(None).cast("string")).alias("description"),
            feed_date(child(names[3])).alias("published_at"),
        )
        out = part if out is None else out.unionByName(part)
    return as_notices(out.where("title is not null and source_url is not null"))


def for_triage(sources: DataFrame, notices: DataFrame) -> DataFrame:
    """The rows of ``sources(source_id, ...)`` that no notice came from: broken, empty or of another kind."""
    return sources.join(notices.select("source_id").distinct(), "source_id", "left_anti")


def parse_sitemaps(maps: DataFrame, xml: str = "xml", url_filter: str | None = "tender") -> DataFrame:
    """SRC-8. (source_id, loc) of the sitemap entries whose address holds ``url_filter``, whatever its case; all without a filter."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc>"), F.lit(1))
    found = maps.select("source_id", F.explode(locs).alias("loc")).select("source_id", plain_text(F.col("loc")).alias("loc")).where("loc is not null")
    return found.where(F.contains(F.lower("loc"), F.lit(url_filter.lower()))) if url_filter else found


def sitemap_notices(locs: DataFrame) -> DataFrame:
    """SRC-9. A stub notice per address, titled by its last part."""
    slug = F.element_at(F.split(F.regexp_replace("loc", "/+$", ""), "/"), -1)
    return as_notices(locs.select("source_id", F.col("loc").alias("source_url"), F.replace(slug, F.lit("-"), F.lit(" ")).alias("title"), F.lit('{"format": "sitemap"}').alias("raw")))


def posts_to_notices(posts: DataFrame, source_id: str | Column) -> DataFrame:
    """SRC-10. Posts (id, date, date_gmt, link, title.rendered, excerpt.rendered); ``date_gmt`` is UTC, else ``date`` is local."""
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, "<[^>]+>", "")), F.lit(""))
    gmt = parse_iso(F.nullif(F.col("date_gmt"), F.lit("")), "+00:00")
    return as_notices(
        posts.select(
            F.lit(source_id).alias("source_id"),
            F.col("link").alias("source_url"),
            F.coalesce(plain(F.col("title.rendered")), F.concat(F.lit("wp-post-"), F.col("id").cast("string"))).alias("title"),
            plain(F.col("excerpt.rendered")).alias("description"),
            F.coalesce(gmt, parse_iso("date")).alias("published_at"),
        )
    )


def first_that_works(*builders):
    """SRC-11. The first scan that yields rows; LookupError if none does, so that the source goes to triage."""
    for build in builders:
        rows = build()
        if rows is not None and not rows.isEmpty():
            return rows
    raise LookupError("no generic scan yields notices")
