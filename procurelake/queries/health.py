"""Queries on source health and scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions.times import backoff_minutes
from procurelake.plans import health as H
from procurelake.plans import schedule as S
from procurelake.plans import stats
from procurelake.queries.tables import HEALTH_AS_OF, health_now, HEALTH_SQL, checks, instant, jobs, sources, table
from procurelake.sources.adapter_source import due_between

WEEK_AGO = "2024-01-24 00:00:00"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.verdicts(H.source_rows(sources(spark, sf_dir), checks(spark, sf_dir)), health_now())


def health_episodes(spark, sf_dir):
    return H.episodes(checks(spark, sf_dir))


def open_episodes(spark, sf_dir):
    return H.open_episodes(checks(spark, sf_dir)).select("source_id", "consecutive_failures", "breakage_started_at", "last_failure_at")


def health_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("source_id", "state", "severity", "page", "consecutive_failures", F.round("minutes_since_success", 3).alias("minutes_since_success"), "sla_minutes", "sla_breached")


def health_paging(spark, sf_dir):
    return H.paging(_judged(spark, sf_dir)).select("source_id", "state", F.round("breakage_minutes", 3).alias("breakage_minutes"))


def health_summary(spark, sf_dir):
    return H.summarise(_judged(spark, sf_dir))


def latest_error(spark, sf_dir):
    c = checks(spark, sf_dir).where("error is not null")
    return c.groupBy("source_id").agg(F.max_by("error", "checked_at").alias("last_error"), F.max("checked_at").alias("checked_at"))


def last_run_distinct_on(spark, sf_dir):
    done = jobs(spark, sf_dir).where(F.col("state").isin("DONE", "FAILED"))
    last = H.latest_by(done, "source_id", [F.col("run_time").desc(), F.col("job_id").desc()])
    return last.select("source_id", "job_id", "state", (F.coalesce("created", F.lit(0)) + F.coalesce("updated", F.lit(0))).alias("notices_last_run"))


def live_job_distinct_on(spark, sf_dir):
    live = jobs(spark, sf_dir).where(F.col("state").isin(*H.LIVE_JOBS))
    return H.latest_by(live, "source_id", [F.col("run_time").desc(), F.col("job_id").desc()]).select("source_id", "job_id", F.col("state").alias("open_job_state"), "next_retry_at")


def mttr_report(spark, sf_dir):
    return H.mttr_report(checks(spark, sf_dir))


def episode_stamps(spark, sf_dir):
    return H.episode_stamps(checks(spark, sf_dir)).select("source_id", "checked_at", "ok", "mttd_started_at")


def crawl_stats_json(spark, sf_dir):
    return H.crawl_stats(jobs(spark, sf_dir), instant(WEEK_AGO))


def jobs_by_state(spark, sf_dir):
    return H.jobs_by_state(jobs(spark, sf_dir), instant(WEEK_AGO))


def freshness_by_tier(spark, sf_dir):
    return H.freshness_by_tier(sources(spark, sf_dir), health_now())


def adapter_health_silent(spark, sf_dir):
    return H.adapter_health(sources(spark, sf_dir), jobs(spark, sf_dir), instant(WEEK_AGO))


def recent_failures_topk(spark, sf_dir):
    return H.recent_failures(sources(spark, sf_dir), checks(spark, sf_dir), 20).select("source_id", "triage_tier", "checked_at", F.col("error").alias("last_error"))


def due_sources(spark, sf_dir):
    return S.due_sources(sources(spark, sf_dir), jobs(spark, sf_dir), health_now()).select("source_id", "frequency_min", "last_checked")


def runnable_jobs(spark, sf_dir):
    return S.runnable_jobs(jobs(spark, sf_dir), instant("2024-01-20 00:00:00")).select("job_id", "source_id", "state", "run_time")


def backoff_schedule(spark, sf_dir):
    j = jobs(spark, sf_dir).where("state = 'FAILED'")
    return j.select("job_id", (F.col("attempts") + 1).alias("attempt"), backoff_minutes(F.col("attempts") + 1).alias("wait_min"), (F.col("run_time") + F.make_dt_interval(mins=backoff_minutes(F.col("attempts") + 1))).alias("retry_at"))


def job_state_machine(spark, sf_dir):
    j = jobs(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    outcomes = j.where("job_id % 2 = 0").select("job_id", (F.col("job_id") % 6 == 0).alias("ok"), F.lit("timeout").alias("error"), F.col("run_time").alias("at"))
    return S.after_run(j, outcomes).select("job_id", "attempts", "state", "next_retry_at")


def source_transitions(spark, sf_dir):
    c = checks(spark, sf_dir)
    status = F.when(F.col("source_id") % 3 == 0, "DEGRADED").when(F.col("source_id") % 3 == 1, "ACTIVE").otherwise("DISCOVERY")
    rows = c.select("source_id", status.alias("status"), "ok", (F.col("source_id") % 5 == 0).alias("final"))
    return rows.withColumn("after", S.source_status_after("status", "ok", "final")).groupBy("status", "ok", "final", "after").agg(F.count("*").alias("n"))


def audit_read(spark, sf_dir):
    from procurelake.queries.tables import table

    audit = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("logged_at"), F.col("event_type").alias("action"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("user_email"), F.lit(None).cast("string").alias("target"), F.col("props").alias("details")
    )
    return S.audit_query(audit, action="click", email="USER1", limit=50).select("id", "logged_at", "action", "user_email")


def due_ticks(spark, sf_dir):
    """How often each source falls due in a day, first and last, in seconds."""
    day = lambda text: F.lit(text).cast("timestamp")
    t = due_between(sources(spark, sf_dir), day(WEEK_AGO), day("2024-01-25 00:00:00"))
    at = F.unix_timestamp("due_at")
    return t.groupBy("source_id").agg(F.count("*").alias("n"), F.min(at).alias("first_due"), F.max(at).alias("last_due"))


def pager_lines(spark, sf_dir):
    """What the pager prints, with its exit code."""
    code, lines = H.pager_report(_judged(spark, sf_dir))
    return lines.select(F.lit(code).alias("code"), "line")


def outcome_counts(spark, sf_dir):
    """Interactions by outcome."""
    return stats.outcome_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


QUERIES = {
    f.__name__: f
    for f in (
        health_episodes, open_episodes, health_verdicts, health_paging, health_summary, latest_error, last_run_distinct_on, live_job_distinct_on, mttr_report, episode_stamps,
        due_ticks, pager_lines, outcome_counts, crawl_stats_json, jobs_by_state, freshness_by_tier, adapter_health_silent, recent_failures_topk, due_sources, runnable_jobs, backoff_schedule, job_state_machine, source_transitions, audit_read,
    )
}

_WITH = f"WITH {HEALTH_SQL}"
_OPEN = """, last_ok AS (SELECT source_id, max(checked_at) AS t FROM checks WHERE ok GROUP BY 1),
opened AS (SELECT c.source_id, count(*) AS consecutive_failures, min(checked_at) AS breakage_started_at, max(checked_at) AS last_failure_at
           FROM checks c LEFT JOIN last_ok l ON l.source_id = c.source_id WHERE NOT ok AND (t IS NULL OR checked_at > t) GROUP BY 1)"""
_JUDGED = f"""{_OPEN}, facts AS (SELECT s.*, coalesce(consecutive_failures, 0) AS failures, epoch_us(TIMESTAMP '{HEALTH_AS_OF}' - last_success) / 6e7 AS since,
  epoch_us(TIMESTAMP '{HEALTH_AS_OF}' - breakage_started_at) / 6e7 AS broken, [30, 120, 360, 1440][triage_tier] AS sla, [240, 240, 1440, 1440][triage_tier] AS target
  FROM sources s LEFT JOIN opened o ON o.source_id = s.source_id),
judged AS (SELECT *, coalesce(since > greatest(sla, 2 * frequency_min), false) AS stale,
  CASE WHEN status IN ('PUBLISH_NOTHING', 'DISCOVERY') THEN status WHEN failures >= 5 THEN 'FAILED' WHEN failures > 0 THEN 'DEGRADED' WHEN last_success IS NULL THEN 'NEVER_RUN'
       WHEN since > greatest(sla, 2 * frequency_min) THEN 'STALE' ELSE 'OK' END AS state FROM facts),
ranked AS (SELECT *, CASE state WHEN 'FAILED' THEN true WHEN 'DEGRADED' THEN coalesce(broken > target, false) WHEN 'NEVER_RUN' THEN triage_tier <= 2 WHEN 'STALE' THEN triage_tier <= 2 ELSE false END AS page,
  list_position(['FAILED', 'DEGRADED', 'STALE', 'NEVER_RUN', 'DISCOVERY', 'PUBLISH_NOTHING', 'OK'], state) - 1 AS severity FROM judged)"""
_EPISODES = """, ordered AS (SELECT *, lag(ok) OVER (PARTITION BY source_id ORDER BY checked_at) AS prev_ok FROM checks),
starts AS (SELECT source_id, checked_at AS started_at FROM ordered WHERE NOT ok AND coalesce(prev_ok, true)),
episodes AS (SELECT s.source_id, s.started_at, min(c.checked_at) AS recovered_at FROM starts s LEFT JOIN checks c ON c.source_id = s.source_id AND c.ok AND c.checked_at > s.started_at GROUP BY 1, 2)"""
_BACK = "CAST(15 * pow(2, least(attempts, 4)) AS INT)"

ORACLE_SQL = {
    "health_episodes": f"{_WITH}{_EPISODES} SELECT source_id, started_at, recovered_at FROM episodes",
    "open_episodes": f"{_WITH}{_OPEN} SELECT source_id, consecutive_failures, breakage_started_at, last_failure_at FROM opened",
    "health_verdicts": f"{_WITH}{_JUDGED} SELECT source_id, state, CAST(severity AS INT) AS severity, page, failures AS consecutive_failures, round(since, 3) AS minutes_since_success, sla AS sla_minutes, stale AS sla_breached FROM ranked",
    "health_paging": f"{_WITH}{_JUDGED} SELECT source_id, state, round(broken, 3) AS breakage_minutes FROM ranked WHERE page",
    "health_summary": f"""{_WITH}{_JUDGED} SELECT count(*) AS sources_total, count(*) FILTER (state NOT IN ('PUBLISH_NOTHING', 'DISCOVERY')) AS crawlable, count(*) FILTER (state = 'OK') AS healthy,
      round(100.0::DOUBLE * count(*) FILTER (state = 'OK') / count(*) FILTER (state NOT IN ('PUBLISH_NOTHING', 'DISCOVERY')), 1) AS healthy_pct, count(*) FILTER (page) AS paging,
      100.0::DOUBLE * count(*) FILTER (state = 'OK') / count(*) FILTER (state NOT IN ('PUBLISH_NOTHING', 'DISCOVERY')) >= 95 AS sla_met FROM ranked""",
    "due_ticks": f"""{_WITH}, t AS (SELECT source_id, 60 * frequency_min AS step, epoch(TIMESTAMP '{WEEK_AGO}')::BIGINT AS a, epoch(TIMESTAMP '2024-01-25 00:00:00')::BIGINT AS b FROM sources)
      SELECT source_id, b // step - a // step AS n, (a // step + 1) * step AS first_due, b // step * step AS last_due FROM t WHERE b // step > a // step""",
    "pager_lines": f"{_WITH}{_JUDGED} SELECT 2 AS code, state || ' ' || source_id AS line FROM ranked WHERE page",
    "outcome_counts": "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1",
    "latest_error": f"{_WITH} SELECT source_id, arg_max(error, checked_at) AS last_error, max(checked_at) AS checked_at FROM checks WHERE error IS NOT NULL GROUP BY 1",
    "last_run_distinct_on": f"""{_WITH} SELECT DISTINCT ON (source_id) source_id, job_id, state, CASE WHEN state = 'DONE' THEN k + k % 3 ELSE 0 END AS notices_last_run
      FROM jobs WHERE state IN ('DONE', 'FAILED') ORDER BY source_id, run_time DESC, job_id DESC""",
    "live_job_distinct_on": f"""{_WITH} SELECT DISTINCT ON (source_id) source_id, job_id, state AS open_job_state, next_retry_at
      FROM jobs WHERE state IN ('PENDING', 'FETCHING', 'PARSING', 'RETRY_BACKOFF') ORDER BY source_id, run_time DESC, job_id DESC""",
    "mttr_report": f"""{_WITH}{_EPISODES}, m AS (SELECT recovered_at, epoch_us(recovered_at - started_at) / 6e7 AS repair FROM episodes)
      SELECT count(*) AS episodes, count(recovered_at) AS resolved, count(*) - count(recovered_at) AS open, round(avg(repair), 1) AS avg_mttr_min, round(max(repair), 1) AS max_mttr_min, coalesce(avg(repair), 0) <= 1440 AS mttr_met FROM m""",
    "episode_stamps": f"""{_WITH}, island AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source_id ORDER BY checked_at ROWS UNBOUNDED PRECEDING) AS i FROM checks)
      SELECT source_id, checked_at, ok, CASE WHEN NOT ok THEN min(CASE WHEN NOT ok THEN checked_at END) OVER (PARTITION BY source_id, i) END AS mttd_started_at FROM island""",
    "crawl_stats_json": f"""{_WITH} SELECT count(*) AS jobs_total, count(*) FILTER (state = 'DONE') AS done, round(100.0::DOUBLE * count(*) FILTER (state = 'DONE') / count(*), 1) AS job_success_pct,
      coalesce(sum(k) FILTER (state = 'DONE'), 0)::BIGINT AS tenders_created, coalesce(sum(k % 3) FILTER (state = 'DONE'), 0)::BIGINT AS tenders_updated FROM jobs WHERE run_time > TIMESTAMP '{WEEK_AGO}'""",
    "jobs_by_state": f"{_WITH} SELECT state, count(*) AS n FROM jobs WHERE run_time > TIMESTAMP '{WEEK_AGO}' GROUP BY 1",
    "freshness_by_tier": f"""{_WITH}, aged AS (SELECT triage_tier, last_success, epoch_us(TIMESTAMP '{HEALTH_AS_OF}' - last_success) / 6e7 AS age FROM sources WHERE status NOT IN ('PUBLISH_NOTHING', 'INACTIVE'))
      SELECT triage_tier, count(*) AS sources, count(last_success) AS ever_succeeded, round(avg(age), 1) AS avg_age_min, round(max(age), 1) AS max_age_min, [30, 120, 360, 1440][triage_tier] AS sla_minutes,
      coalesce(round(max(age), 1) <= [30, 120, 360, 1440][triage_tier], false) AS within_sla FROM aged GROUP BY triage_tier""",
    "adapter_health_silent": f"""{_WITH} SELECT coalesce(adapter, '(none)') AS adapter, count(DISTINCT s.source_id) AS sources, count(job_id) AS runs, count(*) FILTER (state = 'DONE') AS ok, count(*) FILTER (state = 'FAILED') AS failed,
      coalesce(sum(k) FILTER (state = 'DONE'), 0)::BIGINT AS created, round(100.0::DOUBLE * count(*) FILTER (state = 'DONE') / nullif(count(job_id), 0), 1) AS success_pct,
      count(*) FILTER (state = 'DONE') > 0 AND coalesce(sum(k) FILTER (state = 'DONE'), 0) = 0 AS silent
      FROM sources s LEFT JOIN jobs j ON j.source_id = s.source_id AND run_time > TIMESTAMP '{WEEK_AGO}' GROUP BY 1""",
    "recent_failures_topk": f"{_WITH} SELECT c.source_id, triage_tier, checked_at, error AS last_error FROM checks c JOIN sources s ON s.source_id = c.source_id WHERE error IS NOT NULL ORDER BY checked_at DESC, c.source_id LIMIT 20",
    "due_sources": f"""{_WITH} SELECT source_id, frequency_min, last_checked FROM sources s WHERE status = 'ACTIVE' AND adapter IS NOT NULL AND (last_checked IS NULL OR last_checked < TIMESTAMP '{HEALTH_AS_OF}' - to_minutes(frequency_min))
      AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_id = s.source_id AND state IN ('PENDING', 'FETCHING', 'PARSING', 'RETRY_BACKOFF'))""",
    "runnable_jobs": f"{_WITH} SELECT job_id, source_id, state, run_time FROM jobs WHERE state = 'PENDING' OR (state = 'RETRY_BACKOFF' AND next_retry_at <= TIMESTAMP '2024-01-20 00:00:00')",
    "backoff_schedule": f"{_WITH} SELECT job_id, attempts + 1 AS attempt, {_BACK} AS wait_min, run_time + to_minutes({_BACK}) AS retry_at FROM jobs WHERE state = 'FAILED'",
    "job_state_machine": f"""{_WITH}, ran AS (SELECT *, job_id % 2 = 0 AS r, job_id % 6 = 0 AS good, CAST(attempts + CASE WHEN job_id % 2 = 0 AND job_id % 6 <> 0 THEN 1 ELSE 0 END AS INT) AS n FROM jobs),
      moved AS (SELECT *, CASE WHEN NOT r THEN state WHEN good THEN 'DONE' WHEN n >= 5 THEN 'FAILED' ELSE 'RETRY_BACKOFF' END AS st FROM ran)
      SELECT job_id, n AS attempts, st AS state, CASE WHEN st = 'RETRY_BACKOFF' THEN CASE WHEN r THEN run_time + to_minutes(CAST(15 * pow(2, least(n - 1, 4)) AS INT)) ELSE next_retry_at END END AS next_retry_at FROM moved""",
    "source_transitions": f"""{_WITH}, r AS (SELECT CASE source_id % 3 WHEN 0 THEN 'DEGRADED' WHEN 1 THEN 'ACTIVE' ELSE 'DISCOVERY' END AS status, ok, source_id % 5 = 0 AS final FROM checks)
      SELECT status, ok, final, CASE WHEN ok AND status = 'DEGRADED' THEN 'ACTIVE' WHEN NOT ok AND final THEN 'FAILED' WHEN NOT ok AND status = 'ACTIVE' THEN 'DEGRADED' ELSE status END AS after, count(*) AS n FROM r GROUP BY ALL""",
    "audit_read": """SELECT event_id AS id, ts AS logged_at, event_type AS action, 'user' || user_id || '@example.org' AS user_email FROM events
      WHERE event_type = 'click' AND 'user' || user_id || '@example.org' LIKE '%user1%' ORDER BY ts DESC, event_id DESC LIMIT 50""",
}
