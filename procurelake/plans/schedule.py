"""Crawl scheduling: due sources, job states, repairs, discovery (OP-P12 to OP-P17, OP-J5, OP-J8, OP-D11, OP-D12, SNK-8, SNK-16, SNK-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.functions.times import DEFAULT_MINUTES, backoff_minutes
from procurelake.operators.normalize import STRUCTURED, provenance
from procurelake.operators.versions import CHANGE, plain
from procurelake.plans.health import LIVE_JOBS
from procurelake.schemas import PROVENANCE, release
from procurelake.sources.ocds import release_to_notice

CRAWLED = ("ACTIVE", "DEGRADED", "FAILED_RECOVERABLE")
MOST_ATTEMPTS = 5
MOST_RAW_NOTICES = 200


def due_sources(sources: DataFrame, jobs: DataFrame, as_of: Column, statuses: tuple[str, ...] = CRAWLED) -> DataFrame:
    """OP-P12, OP-J8. Crawled sources that were never checked or not within their interval, and have no live job."""
    wait = F.make_dt_interval(mins=F.coalesce("frequency_min", F.lit(DEFAULT_MINUTES)))
    due = sources.where(F.col("status").isin(*statuses) & F.col("adapter").isNotNull() & (F.col("last_checked").isNull() | (F.col("last_checked") < as_of - wait)))
    return due.join(jobs.where(F.col("state").isin(*LIVE_JOBS)).select("source_id"), "source_id", "left_anti")


def runnable_jobs(jobs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """OP-P13. Pending jobs and retries whose time has come, oldest first."""
    ready = jobs.where((F.col("state") == "PENDING") | ((F.col("state") == "RETRY_BACKOFF") & (F.col("next_retry_at") <= as_of))).orderBy("run_time", "job_id")
    return ready.limit(limit) if limit else ready


def is_structured(raw) -> Column:
    """OP-P14. Feeds, APIs and posts have fields; sitemaps and bulletins do not."""
    return ~F.coalesce(F.get_json_object(raw, "$.format"), F.lit("")).isin("sitemap", "pdf_bulletin")


def after_run(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """OP-D11. Jobs after ``outcomes(job_id, ok, error, at)``: DONE, RETRY_BACKOFF with the next time, or FAILED at the last attempt. Of several outcomes of a job the first counts."""
    one = outcomes.groupBy("job_id").agg(F.min_by(F.struct("ok", "error", "at"), F.struct("at", "ok", "error")).alias("o"))
    both = jobs.join(one.select("job_id", "o.ok", F.col("o.error").alias("__error"), "o.at"), "job_id", "left")
    ran = F.col("ok").isNotNull()
    attempts = F.col("attempts") + F.when(ran & ~F.col("ok"), 1).otherwise(0)
    state = F.when(~ran, F.col("state")).when(F.col("ok"), "DONE").when(attempts >= MOST_ATTEMPTS, "FAILED").otherwise("RETRY_BACKOFF")
    retry = F.when(state == "RETRY_BACKOFF", F.when(ran, F.col("at") + F.make_dt_interval(mins=backoff_minutes(attempts))).otherwise(F.col("next_retry_at")))
    return both.select(*[c for c in jobs.columns if c not in ("attempts", "state", "next_retry_at", "error")], attempts.alias("attempts"), state.alias("state"), retry.alias("next_retry_at"), F.when(ran, F.col("__error")).otherwise(F.col("error")).alias("error"))


def source_status_after(status, ok, final) -> Column:
    """OP-D12. Success lifts a degraded source; failure degrades, the last one fails; other states stay."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(ok) & (c(status) == "DEGRADED"), "ACTIVE").when(~c(ok) & c(final), "FAILED").when(~c(ok) & (c(status) == "ACTIVE"), "DEGRADED").otherwise(c(status))


def result_rows(results: DataFrame) -> DataFrame:
    """SNK-8. Crawl results for the log: at most 200 raw notices each, counters as JSON."""
    return results.withColumn("raw", F.slice("raw", 1, MOST_RAW_NOTICES)).withColumn("extracted_fields", F.to_json(F.struct("created", "updated")))


def latest_archive(archive: DataFrame) -> DataFrame:
    """OP-J5. The last release of each ocid."""
    return archive.groupBy("ocid").agg(F.max_by(F.struct(*[c for c in archive.columns if c != "ocid"]), F.struct("archived_at", "release_id")).alias("r")).select("ocid", "r.*")


#: The times that a repair looks at, the note of one without a note, and the label of its version.
REPAIRED, REPAIR_NOTE, REPAIR_KIND = ("closing_at", "briefing_at", "published_at"), "timezone corrected", "TIMEZONE_CORRECTION"


def timezone_repairs(tenders: DataFrame, archive: DataFrame, versions: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """SNK-18. (repaired tenders, version rows): the archived originals are read again and only times that differ are written; nothing after a repair.

    ``tenders(tender_id, ocid, closing_at, briefing_at, published_at, field_provenance, ...)``,
    ``archive(ocid, release_id, raw, archived_at)``, ``versions(tender_id, version_no)``. Rows that need no
    repair are left out; a repaired field is DERIVED with the note of its repair.
    """
    said = latest_archive(archive).where("raw is not null").select(F.from_json("raw", release()).alias("r"))
    read = release_to_notice(said.select("r.*", F.lit("").alias("source_url")), source_id)
    new = read.select(F.get_json_object("raw", "$.ocid").alias("ocid"), "derived_fields", *[F.col(f).alias(f"__{f}") for f in REPAIRED])
    both = tenders.where("ocid is not null").join(new, "ocid")
    differs = {f: F.col(f"__{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in REPAIRED}
    change = lambda f: F.when(differs[f], F.struct(F.lit(f).alias("field"), plain(F.col(f), "timestamp").alias("old"), plain(F.col(f"__{f}"), "timestamp").alias("new")))
    both = both.withColumn("changes", F.array_compact(F.array(*map(change, REPAIRED))).cast(CHANGE)).where(F.size("changes") > 0)
    note = lambda f: F.element_at("derived_fields", f)
    patch = [F.when(differs[f] & note(f).isNotNull(), F.struct(F.lit(f).alias("key"), provenance(F.lit("DERIVED"), F.lit(source_id), STRUCTURED, F.coalesce(note(f), F.lit(REPAIR_NOTE))).alias("value"))) for f in REPAIRED]
    both = both.withColumn("__patch", F.map_from_entries(F.array_compact(F.array(*patch))))
    kept = F.map_filter(F.coalesce("field_provenance", F.create_map().cast(f"map<string,{PROVENANCE}>")), lambda k, _: ~F.map_contains_key("__patch", k))
    cols = {f: F.coalesce(f"__{f}", f) for f in REPAIRED} | {"field_provenance": F.map_concat(kept, "__patch")}
    repaired = both.select(*[cols.get(c, F.col(c)).alias(c) for c in tenders.columns])
    return repaired, next_versions(versions, both.select("tender_id", "changes", F.lit(REPAIR_KIND).alias("kind")), "tender_id", "tender_id")


def discovery_update(sources: DataFrame, found: DataFrame) -> DataFrame:
    """SNK-16, OP-P17, OP-A15. Sources in discovery after ``found(source_id, platform, adapter, crawl_method, confidence)``: workable ones become active."""
    both = sources.where("status = 'DISCOVERY'").join(found.withColumnsRenamed({c: f"__{c}" for c in ("platform", "adapter", "crawl_method")}), "source_id")
    return both.select(
        "source_id", F.when(F.col("__adapter").isNotNull(), "ACTIVE").otherwise("DISCOVERY").alias("status"), F.col("__platform").alias("platform"), F.coalesce("__adapter", "adapter").alias("adapter"),
        F.map_concat(F.coalesce("config", F.create_map().cast("map<string,string>")), F.create_map(F.lit("probe_confidence"), F.col("confidence").cast("string"))).alias("config"),
    )


def discovery_counts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """OP-A15. (outcome, n): probed sources that became active, stayed in discovery, or had no answer."""
    asked = sources.where("status = 'DISCOVERY'").select("source_id", "adapter")
    both = asked.join(found.select("source_id", F.col("adapter").alias("__adapter"), F.lit(True).alias("__met")), "source_id", "left")
    outcome = F.when(F.col("__met").isNull(), "unreachable").when(F.col("__adapter").isNotNull(), "activated").otherwise("undecided")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: What no audit row may hold.
SECRETS = ("password", "password_hash", "token", "session_token", "secret", "cookie")


def audit_rows(events: DataFrame) -> DataFrame:
    """SNK-12. Rows to append to the log from ``events(table_name, record_id, action, user_id, actor, detail map)``.

    Secrets are left out of the details, the actor is put in where it is not there, and rows without an action
    or table are dropped instead of failing what they report on.
    """
    fit = events.where(F.col("action").isNotNull() & F.col("table_name").isNotNull())
    clean = F.map_filter(F.coalesce("detail", F.create_map().cast("map<string,string>")), lambda k, _: ~F.lower(k).isin(*SECRETS))
    actor = F.when(F.col("actor").isNotNull() & ~F.map_contains_key(clean, "actor"), F.create_map(F.lit("actor"), F.col("actor"))).otherwise(F.create_map().cast("map<string,string>"))
    return fit.select("table_name", "record_id", "action", "user_id", F.to_json(F.map_concat(clean, actor)).alias("details"))


def upsert_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK-17. ``users(email, name)`` after ``incoming(email, name, at)``: the last name that is not empty stays, else the one that was there; addresses are told apart without case."""
    last = incoming.groupBy(F.lower("email").alias("email")).agg(F.max_by(F.nullif("name", F.lit("")), F.when(F.col("name") != "", F.col("at"))).alias("__name"))
    both = users.withColumn("email", F.lower("email")).join(last, "email", "full")
    return both.withColumn("name", F.coalesce("__name", "name")).drop("__name")


def audit_query(audit: DataFrame, *, action: str | None = None, email: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """OP-P16, OP-S4. The newest audit rows; ``email`` is looked for in the user, the target and the details."""
    rows = audit if action is None else audit.where(F.col("action") == action)
    if email is not None:
        like = f"%{email.lower()}%"
        rows = rows.where(F.lower(F.coalesce("user_email", F.lit(""))).like(like) | F.lower(F.coalesce("target", F.lit(""))).like(like) | F.lower(F.coalesce(F.get_json_object("details", "$.email"), F.lit(""))).like(like))
    return rows.orderBy(F.col("logged_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """OP-P19, OP-J12. Users with the number of sessions neither expired nor revoked."""
    live = sessions.where((F.col("expires_at") > as_of) & F.col("revoked_at").isNull()).groupBy("user_id").agg(F.count("*").alias("live"))
    return users.join(live, "user_id", "left").withColumn("live", F.coalesce("live", F.lit(0)))


def next_versions(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-5, OP-A13. ``incoming`` numbered on from the highest stored version of its key."""
    top = existing.groupBy(key).agg(F.max("version_no").alias("__top"))
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return incoming.join(top, key, "left").withColumn("version_no", F.coalesce("__top", F.lit(0)) + k).drop("__top")
