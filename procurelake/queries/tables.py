"""The star-schema tables in the shapes of the engine's records, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEALTH_AS_OF = "2024-01-31 00:00:00"
TENDER_AS_OF = "1998-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def health_now():
    return instant(HEALTH_AS_OF)


def tender_now():
    return instant(TENDER_AS_OF)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as health checks: an ``error`` is a failure."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), (~failed).alias("ok"), F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawl jobs: errors failed, purchases pend, signups wait for a retry, the rest is done; the yield is the JSON's k."""
    state = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_id") % 97 == 0, "PENDING").when(F.col("event_id") % 89 == 0, "RETRY_BACKOFF").otherwise("DONE")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("run_time"), state.alias("state"), (F.col("event_id") % 5).cast("int").alias("attempts"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("next_retry_at"), F.when(state == "DONE", k).alias("created"), F.when(state == "DONE", k % 3).alias("updated"),
        F.when(state == "DONE", F.to_json(F.struct(k.alias("created"), (k % 3).alias("updated")))).alias("extracted_fields"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as registered sources: tier from the id, interval from the tier's limit, status and adapter from the id."""
    users = checks(spark, sf_dir).groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("checked_at"))).alias("last_success"), F.max("checked_at").alias("last_checked"))
    tier = (F.col("source_id") % 4 + 1).cast("int")
    sla = F.element_at(F.array(*[F.lit(x) for x in (30, 120, 360, 1440)]), tier)
    status = F.when(F.col("source_id") % 41 == 0, "PUBLISH_NOTHING").when(F.col("source_id") % 37 == 0, "DISCOVERY").otherwise("ACTIVE")
    adapter = F.when(F.col("source_id") % 29 != 0, F.element_at(F.array(*[F.lit(x) for x in ("ocds_api", "generic_cms", "generic_sitemap_rss", "pdf_bulletin")]), (F.col("source_id") % 4 + 1).cast("int")))
    return users.select("source_id", tier.alias("triage_tier"), sla.alias("frequency_min"), status.alias("status"), adapter.alias("adapter"), "last_success", "last_checked")


#: The same in SQL, as leading common table expressions.
HEALTH_SQL = """
checks AS (SELECT user_id AS source_id, ts AS checked_at, event_type <> 'error' AS ok,
                  CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events),
jobs AS (SELECT event_id AS job_id, user_id AS source_id, ts AS run_time,
                CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 97 = 0 THEN 'PENDING' WHEN event_id % 89 = 0 THEN 'RETRY_BACKOFF' ELSE 'DONE' END AS state,
                CAST(event_id % 5 AS INT) AS attempts, ts + INTERVAL 30 MINUTE AS next_retry_at, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
sources AS (SELECT user_id AS source_id, CAST(user_id % 4 + 1 AS INT) AS triage_tier, [30, 120, 360, 1440][user_id % 4 + 1] AS frequency_min,
                   CASE WHEN user_id % 41 = 0 THEN 'PUBLISH_NOTHING' WHEN user_id % 37 = 0 THEN 'DISCOVERY' ELSE 'ACTIVE' END AS status,
                   CASE WHEN user_id % 29 <> 0 THEN ['ocds_api', 'generic_cms', 'generic_sitemap_rss', 'pdf_bulletin'][user_id % 4 + 1] END AS adapter,
                   max(CASE WHEN event_type <> 'error' THEN ts END) AS last_success, max(ts) AS last_checked FROM events GROUP BY user_id)
"""

PROVINCE_NAMES = ("Eastern Cape", "Free State", "Gauteng", "KwaZulu-Natal", "Limpopo", "Mpumalanga", "North West", "Northern Cape", "Western Cape")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tenders: published on the order date, closing up to 59 days later, some without a date or hour."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    closing = F.when(key % 13 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(key % 60).cast("int"), hours=(key % 24).cast("int")))
    province = F.when(key % 10 != 0, F.element_at(F.array(*map(F.lit, PROVINCE_NAMES)), (key % 9 + 1).cast("int")))
    status = F.element_at(F.array(*map(F.lit, ("OPEN", "CLOSING_SOON", "CLOSED", "CANCELLED", "AWARDED"))), (key % 5 + 1).cast("int"))
    return o.select(
        key.alias("id"), F.concat(F.lit("SCM "), F.lpad((key % 1000).cast("string"), 4, "0"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("tender_number"),
        F.col("o_custkey").alias("buyer_org_id"), F.concat(F.lit("City of Customer#"), F.col("o_custkey").cast("string")).alias("buyer_name"),
        F.concat(F.col("o_orderpriority"), F.lit(" supply of item "), (key % 50).cast("string")).alias("title"), province.alias("province"), status.alias("status"),
        F.col("o_orderdate").alias("published_at"), closing.alias("closing_at"), F.when(key % 3 != 0, key % 3 == 1).alias("compulsory_briefing"),
        (key % 101).cast("int").alias("authority_score"), F.col("o_totalprice").alias("value_estimated"), ((key % 20) / F.lit(20.0) + 0.05).alias("closing_confidence"),
    )


TENDER_SQL = f"""
tenders AS (SELECT o_orderkey AS id, 'SCM ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') || '/' || year(o_orderdate) AS tender_number,
  o_custkey AS buyer_org_id, 'City of Customer#' || o_custkey AS buyer_name, o_orderpriority || ' supply of item ' || (o_orderkey % 50) AS title,
  CASE WHEN o_orderkey % 10 <> 0 THEN {list(PROVINCE_NAMES)}[o_orderkey % 9 + 1] END AS province,
  ['OPEN', 'CLOSING_SOON', 'CLOSED', 'CANCELLED', 'AWARDED'][o_orderkey % 5 + 1] AS status,
  o_orderdate AS published_at,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) + to_hours(CAST(o_orderkey % 24 AS INT)) END AS closing_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END AS compulsory_briefing, CAST(o_orderkey % 101 AS INT) AS authority_score,
  o_totalprice AS value_estimated, (o_orderkey % 20)::DOUBLE / 20.0::DOUBLE + 0.05::DOUBLE AS closing_confidence FROM orders)
"""
