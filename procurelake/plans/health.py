"""Source health: failure episodes, verdicts, freshness, repair times (OP-H1 to OP-H9, OP-D15 to OP-D17, OP-A2 to OP-A9, OP-W1 to OP-W3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.functions.times import TIER_MTTD, TIER_SLA, by_tier, minutes_between

#: States from worst to best, failures that end retrying, grace in polling windows, targets.
SEVERITY = ("FAILED", "DEGRADED", "STALE", "NEVER_RUN", "DISCOVERY", "PUBLISH_NOTHING", "OK")
TERMINAL_FAILURES, GRACE_WINDOWS = 5, 2
HEALTHY_TARGET, MTTR_TARGET = 95.0, 1440
LIVE_JOBS = ("PENDING", "FETCHING", "PARSING", "RETRY_BACKOFF")


def open_episodes(checks: DataFrame) -> DataFrame:
    """OP-H8, OP-A6, OP-J4. Failures after each source's last success: (source_id, consecutive_failures, breakage_started_at, last_failure_at).

    ``checks(source_id, checked_at, ok, started_at)``; a stamped start wins over the first failing check.
    """
    last = checks.where("ok").groupBy("source_id").agg(F.max("checked_at").alias("last_ok"))
    failed = checks.where("not ok").join(last, "source_id", "left").where("last_ok is null or checked_at > last_ok")
    return failed.groupBy("source_id").agg(
        F.count("*").alias("consecutive_failures"), F.coalesce(F.min("started_at"), F.min("checked_at")).alias("breakage_started_at"), F.max("checked_at").alias("last_failure_at")
    )


def latest_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """OP-W3. The first row of each key in the given order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def source_rows(sources: DataFrame, checks: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """OP-H1, OP-J3. One row per source with its open episode, latest error and, with ``jobs``, live job and last run."""
    out = sources.join(open_episodes(checks), "source_id", "left")
    errors = checks.where("error is not null").groupBy("source_id").agg(F.max_by("error", "checked_at").alias("last_error"))
    out = out.join(errors, "source_id", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    if jobs is not None:
        newest = [F.col("run_time").desc(), F.col("job_id").desc()]
        live = latest_by(jobs.where(F.col("state").isin(*LIVE_JOBS)), "source_id", newest).select("source_id", F.col("state").alias("open_job_state"), "next_retry_at")
        done = latest_by(jobs.where(F.col("state").isin("DONE", "FAILED")), "source_id", newest).select("source_id", F.col("state").alias("last_job_state"), (F.coalesce("created", F.lit(0)) + F.coalesce("updated", F.lit(0))).alias("notices_last_run"))
        out = out.join(live, "source_id", "left").join(done, "source_id", "left")
    return out


def verdicts(rows: DataFrame, as_of: Column) -> DataFrame:
    """OP-D15. State, severity, page and the figures behind them, first rule first.

    Needs source_id, status, triage_tier, frequency_min, last_success, consecutive_failures, breakage_started_at.
    """
    status = F.upper(F.coalesce("status", F.lit("")))
    sla, target = by_tier("triage_tier", TIER_SLA), by_tier("triage_tier", TIER_MTTD)
    since, broken = minutes_between("last_success", as_of), minutes_between("breakage_started_at", as_of)
    threshold = F.greatest(sla, F.coalesce("frequency_min", sla) * GRACE_WINDOWS)
    stale = F.coalesce(since > threshold, F.lit(False))
    failures = F.coalesce("consecutive_failures", F.lit(0))
    early_tier = F.coalesce(F.col("triage_tier").isin(1, 2), F.lit(False))
    late = F.coalesce(broken > target, F.lit(False))
    rules = [
        (status.isin("PUBLISH_NOTHING", "INACTIVE"), "PUBLISH_NOTHING", F.lit(False)),
        (status == "DISCOVERY", "DISCOVERY", F.lit(False)),
        ((status == "FAILED") | (failures >= TERMINAL_FAILURES), "FAILED", F.lit(True)),
        ((status == "DEGRADED") | (failures > 0), "DEGRADED", late),
        (F.col("last_success").isNull(), "NEVER_RUN", early_tier),
        (stale, "STALE", early_tier),
    ]
    state, page = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for rule, name, pages in rules[1:]:
        state, page = state.when(rule, name), page.when(rule, pages)
    out = rows.withColumns(
        {
            "state": state.otherwise("OK"), "page": page.otherwise(False), "minutes_since_success": since, "breakage_minutes": broken,
            "sla_minutes": sla, "mttd_target_minutes": target, "stale_threshold_min": threshold, "sla_breached": stale,
        }
    )
    return out.withColumn("severity", (F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("state")) - 1).cast("int"))


def paging(judged: DataFrame) -> DataFrame:
    """OP-D16, OP-S5. Verdicts that page, worst first."""
    return judged.where("page").orderBy("severity", F.coalesce("breakage_minutes", F.lit(0.0)).desc(), "source_id")


def summarise(judged: DataFrame) -> DataFrame:
    """OP-A9. One row of headline numbers; sources that are not expected to publish do not count as crawlable."""
    excluded = F.col("state").isin("PUBLISH_NOTHING", "DISCOVERY")
    share = F.lit(100.0) * F.count_if(F.col("state") == "OK") / F.nullif(F.count_if(~excluded), F.lit(0))
    return judged.agg(
        F.count("*").alias("sources_total"), F.count_if(~excluded).alias("crawlable"), F.count_if(F.col("state") == "OK").alias("healthy"),
        F.round(share, 1).alias("healthy_pct"), F.count_if("page").alias("paging"), F.coalesce(share >= HEALTHY_TARGET, F.lit(False)).alias("sla_met"),
    )


def episodes(checks: DataFrame) -> DataFrame:
    """OP-W1, OP-W2. Every failure episode: (source_id, started_at, recovered_at), recovery being the first success after the start.

    One sort per source: starts by ``lag``, recoveries by a frame that begins strictly after the row's time.
    """
    by = Window.partitionBy("source_id").orderBy("checked_at")
    micros = Window.partitionBy("source_id").orderBy("micros").rangeBetween(1, Window.unboundedFollowing)
    rows = checks.withColumn("micros", F.unix_micros(F.col("checked_at").cast("timestamp")))
    marked = rows.withColumn("prev_ok", F.lag("ok").over(by)).withColumn("recovered_at", F.min(F.when(F.col("ok"), F.col("checked_at"))).over(micros))
    return marked.where("not ok and coalesce(prev_ok, true)").select("source_id", F.col("checked_at").alias("started_at"), "recovered_at")


def mttr_report(checks: DataFrame) -> DataFrame:
    """OP-H6, OP-A8. Episodes, resolved, open, mean and longest repair in minutes; met when no repair has been slow, or none was needed."""
    repair = minutes_between("started_at", "recovered_at")
    mean = F.avg(repair)
    return episodes(checks).agg(
        F.count("*").alias("episodes"), F.count("recovered_at").alias("resolved"), (F.count("*") - F.count("recovered_at")).alias("open"),
        F.round(mean, 1).alias("avg_mttr_min"), F.round(F.max(repair), 1).alias("max_mttr_min"), (F.coalesce(mean, F.lit(0.0)) <= MTTR_TARGET).alias("mttr_met"),
    )


def episode_stamps(checks: DataFrame) -> DataFrame:
    """OP-H9, SNK-9. Each check with mttd_started_at: the first failure of its island between successes, null on success."""
    by = Window.partitionBy("source_id").orderBy("checked_at")
    island = checks.withColumn("__island", F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.min(F.when(~F.col("ok"), F.col("checked_at"))).over(Window.partitionBy("source_id", "__island"))
    return island.withColumn("mttd_started_at", F.when(~F.col("ok"), start)).drop("__island")


def crawl_stats(jobs: DataFrame, since: Column) -> DataFrame:
    """OP-H2, OP-A2, OP-A3. Jobs, success share and yield after ``since``; the yield is read from JSON counters."""
    recent = jobs.where(F.col("run_time") > since)
    count = lambda name: F.coalesce(F.sum(F.get_json_object("extracted_fields", f"$.{name}").try_cast("int")), F.lit(0))
    done = F.count_if(F.col("state") == "DONE")
    return recent.agg(F.count("*").alias("jobs_total"), done.alias("done"), F.round(F.lit(100.0) * done / F.nullif(F.count("*"), F.lit(0)), 1).alias("job_success_pct"), count("created").alias("tenders_created"), count("updated").alias("tenders_updated"))


def jobs_by_state(jobs: DataFrame, since: Column) -> DataFrame:
    return jobs.where(F.col("run_time") > since).groupBy("state").agg(F.count("*").alias("n"))


def freshness_by_tier(sources: DataFrame, as_of: Column) -> DataFrame:
    """OP-H3, OP-A4. Age of the last success by tier against its limit."""
    age = minutes_between("last_success", as_of)
    grouped = sources.where(~F.coalesce(F.col("status").isin("PUBLISH_NOTHING", "INACTIVE"), F.lit(False))).groupBy("triage_tier")
    out = grouped.agg(F.count("*").alias("sources"), F.count("last_success").alias("ever_succeeded"), F.avg(age).alias("avg_age"), F.max(age).alias("max_age"))
    sla = by_tier("triage_tier", TIER_SLA)
    return out.select(
        "triage_tier", "sources", "ever_succeeded", F.round("avg_age", 1).alias("avg_age_min"), F.round("max_age", 1).alias("max_age_min"), sla.alias("sla_minutes"),
        F.coalesce(F.round("max_age", 1) <= sla, F.lit(False)).alias("within_sla"),
    )


def adapter_health(sources: DataFrame, jobs: DataFrame, since: Column) -> DataFrame:
    """OP-H4, OP-A5, OP-J6. Runs, failures and yield by adapter; silent: runs succeed and nothing is ever created."""
    recent = jobs.where(F.col("run_time") > since)
    joined = sources.select("source_id", F.coalesce("adapter", F.lit("(none)")).alias("adapter")).join(recent, "source_id", "left")
    ok, runs = F.count_if(F.col("state") == "DONE"), F.count("job_id")
    created = F.coalesce(F.sum(F.get_json_object("extracted_fields", "$.created").try_cast("int")), F.lit(0))
    return joined.groupBy("adapter").agg(
        F.count_distinct("source_id").alias("sources"), runs.alias("runs"), ok.alias("ok"), F.count_if(F.col("state") == "FAILED").alias("failed"), created.alias("created"),
        F.round(F.lit(100.0) * ok / F.nullif(runs, F.lit(0)), 1).alias("success_pct"), ((ok > 0) & (created == 0)).alias("silent"),
    )


def recent_failures(sources: DataFrame, checks: DataFrame, limit: int = 20) -> DataFrame:
    """OP-H5, OP-S4, OP-J13."""
    failed = checks.where("error is not null").join(sources.select("source_id", "triage_tier"), "source_id")
    return failed.orderBy(F.col("checked_at").desc(), "source_id").limit(limit)


def pager_report(judged: DataFrame) -> tuple[int, DataFrame]:
    """OP-H7. (exit code, lines): 0 all well, 1 something degraded, 2 something pages; a line for every page, worst first."""
    pages = paging(judged)
    lines = pages.select(F.concat_ws(" ", "state", F.col("source_id").cast("string")).alias("line"))
    if not pages.isEmpty():
        return 2, lines
    return (0 if judged.where("state not in ('OK', 'PUBLISH_NOTHING', 'DISCOVERY')").isEmpty() else 1), lines


def overview(sources: DataFrame, checks: DataFrame, jobs: DataFrame, as_of: Column, days: int = 30) -> dict[str, DataFrame]:
    """OP-D17. The reads of the operations page."""
    judged = verdicts(source_rows(sources, checks, jobs), as_of)
    since = as_of - F.make_dt_interval(F.lit(days))
    return {
        "verdicts": judged.orderBy("severity", "source_id"), "summary": summarise(judged), "crawl": crawl_stats(jobs, as_of - F.make_dt_interval(F.lit(1))),
        "freshness": freshness_by_tier(sources, as_of), "adapters": adapter_health(sources, jobs, as_of - F.make_dt_interval(F.lit(7))),
        "failures": recent_failures(sources, checks), "mttr": mttr_report(checks.where(F.col("checked_at") > since)),
    }
