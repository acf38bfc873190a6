"""Open-contracting releases: file scan, mapping to notices, window generation (SRC-1 to SRC-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.times import no_sentinel, parse_iso, parse_wall_time
from procurelake.schemas import release

REPAIR_NOTE = "publisher marks local time as UTC; clock time kept, zone set to +02:00"


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2. Release packages and bare lists of releases; one row per release with its source_url.

    A package's ``uri`` is the source url, else the file's path. Files that are no JSON give no rows.
    """
    package = T.StructType([T.StructField("uri", T.StringType()), T.StructField("releases", T.ArrayType(release()))])
    # a list at the top becomes one row per element, so both shapes can be told apart by what is set
    schema = T.StructType([*package.fields, *release().fields])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    bare = F.when(F.col("ocid").isNotNull() | F.col("tender").isNotNull(), F.array(F.struct(*release().names)))
    one = rows.select(F.coalesce("uri", "file").alias("source_url"), F.explode(F.coalesce("releases", bare)).alias("r"))
    return one.select("r.*", "source_url")


def given(x) -> Column:
    """Null for the empty string: what is empty counts as missing."""
    return F.nullif(x if isinstance(x, Column) else F.col(x), F.lit(""))


def release_to_notice(releases: DataFrame, source_id: str | Column, *, map_value: bool = False) -> DataFrame:
    """SRC-5. Map releases to notices, repairing the timestamps that claim UTC.

    With ``map_value`` the amount is mapped too, zero meaning none.
    """
    t = lambda name: F.col(f"tender.{name}")
    session = t("briefingSession.isSession")
    closing, closing_fixed = parse_wall_time(t("tenderPeriod.endDate"))
    briefing, briefing_fixed = parse_wall_time(t("briefingSession.date"))
    published, published_fixed = parse_wall_time(F.coalesce(given(t("tenderPeriod.startDate")), given("date")))
    repairs = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(n).alias("key"), F.when(fixed, F.lit(REPAIR_NOTE)).alias("value"))
                    for n, fixed in (("closing_at", closing_fixed), ("briefing_at", briefing_fixed & session), ("published_at", published_fixed))
                ]
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    documents = F.transform(
        F.filter(F.coalesce(t("documents"), F.array().cast(release()["tender"].dataType["documents"].dataType)), lambda d: given(d["url"]).isNotNull()),
        lambda d: F.struct(d["url"].alias("url"), F.coalesce(given(d["title"]), given(d["id"])).alias("filename")),
    )
    categories = F.array_compact(F.array_distinct(F.concat(F.array(given(t("mainProcurementCategory")), given(t("category"))), F.coalesce(t("additionalProcurementCategories"), F.array().cast("array<string>")))))
    columns = [
        F.lit(source_id).alias("source_id"), F.col("source_url"),
        F.coalesce(given(t("description")), given(t("title")), given("ocid")).alias("title"),
        F.coalesce(given(t("title")), given(t("id"))).alias("tender_number"),
        F.coalesce(given("buyer.name"), given(t("procuringEntity.name"))).alias("buyer_name"),
        given(t("description")).alias("description"), given(t("province")).alias("province"), categories.alias("categories"),
        published.alias("published_at"), closing.alias("closing_at"),
        F.when(session, briefing).alias("briefing_at"), F.when(session, t("briefingSession.compulsory")).alias("compulsory_briefing"),
        documents.alias("documents"), F.to_json(F.struct(*release().names)).alias("raw"), repairs.alias("derived_fields"),
    ]
    if map_value:
        amount = F.when(t("value.amount") != 0, t("value.amount"))
        columns += [amount.alias("value_estimated"), F.coalesce(given(t("value.currency")), F.lit("ZAR")).alias("currency")]
    return releases.select(*columns)


def archive_rows(releases: DataFrame) -> DataFrame:
    """SNK-2's input: (ocid, release_id, stage, published_at, raw); releases without an ocid are left out."""
    return releases.where(given("ocid").isNotNull()).select(
        "ocid", given("id").alias("release_id"), F.array_join("tag", ",").alias("stage"), no_sentinel(parse_iso("date")).alias("published_at"),
        F.to_json(F.struct(*release().names)).alias("raw"),
    )


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """SRC-3. (from_day, to_day) of each month that [start, end] touches, the first and last clipped; none if start is later."""
    return windows_of(spark.range(1).select(F.to_date(F.lit(start)).alias("start"), F.to_date(F.lit(end)).alias("end")))


def windows_of(spans: DataFrame) -> DataFrame:
    """SRC-3 for a table of ``spans(..., start, end)`` in days: the other columns with (from_day, to_day) of each month that a span touches; a null or reversed span has none."""
    rest = [c for c in spans.columns if c not in ("start", "end")]
    months = spans.where("start <= end").withColumn("m", F.explode(F.expr("sequence(trunc(start, 'MM'), end, interval 1 month)")))
    return months.select(*rest, F.greatest("m", "start").alias("from_day"), F.least(F.last_day("m"), F.col("end")).alias("to_day"))
