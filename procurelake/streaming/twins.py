"""Incremental twins: episode stamps, idempotent ingest, alert events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from procurelake.functions.times import BACKOFF_DOUBLINGS, BACKOFF_MINUTES
from procurelake.plans.schedule import MOST_ATTEMPTS

STAMPED = "source_id string, checked_at timestamp, ok boolean, mttd_started_at timestamp"


class EpisodeStamp(StatefulProcessor):
    """Keeps the start of each source's open failure episode; a success closes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started = handle.getValueState("started", "started timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        checks = pd.concat(list(rows)).sort_values("checked_at")
        start = self.started.get()[0] if self.started.exists() else None
        stamps = []
        for at, ok in zip(checks["checked_at"], checks["ok"], strict=True):
            start = None if ok else (start if start is not None else at)
            stamps.append(start)
        if start is None:
            self.started.clear()
        else:
            self.started.update((pd.Timestamp(start).to_pydatetime(),))
        yield pd.DataFrame({"source_id": key[0], "checked_at": checks["checked_at"], "ok": checks["ok"], "mttd_started_at": pd.to_datetime(pd.Series(stamps, index=checks.index))})

    def close(self) -> None:
        pass


def stamp_episodes(checks: DataFrame) -> DataFrame:
    """OP-H9, SNK-9 on a stream of ``checks(source_id, checked_at, ok)``; needs the RocksDB state store.

    Within a batch checks are taken in order of time; a check that arrives after a later one of its source was
    stamped counts as the next.
    """
    return checks.groupBy("source_id").transformWithStateInPandas(EpisodeStamp(), STAMPED, "Append", "None")


RETRIES = "job_id long, attempts int, state string, retry_at timestamp"


class BackoffTimer(StatefulProcessor):
    """Counts a job's failures and sets a timer for its next try, which wakes it as PENDING; a success or the last failure ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = pd.concat(list(rows)).sort_values("at")
        n = self.attempts.get()[0] if self.attempts.exists() else 0
        state, retry = "DONE", pd.NaT
        for at, ok in zip(runs["at"], runs["ok"], strict=True):
            n = 0 if ok else n + 1
            state, retry = ("DONE", pd.NaT) if ok else ("FAILED", pd.NaT) if n >= MOST_ATTEMPTS else ("RETRY_BACKOFF", at + pd.Timedelta(minutes=wait_minutes(n)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state == "RETRY_BACKOFF":
            self.attempts.update((n,))
            wait = (retry - runs["at"].iloc[-1]).total_seconds() * 1000
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(wait))
        else:
            self.attempts.clear()
        yield pd.DataFrame({"job_id": [key[0]], "attempts": pd.array([n], "Int32"), "state": [state], "retry_at": pd.to_datetime(pd.Series([retry]))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.attempts.get()[0] if self.attempts.exists() else 0
        yield pd.DataFrame({"job_id": [key[0]], "attempts": pd.array([n], "Int32"), "state": ["PENDING"], "retry_at": pd.to_datetime(pd.Series([pd.NaT]))})

    def close(self) -> None:
        pass


def wait_minutes(attempt: int) -> int:
    """OP-F16 on a number: 15, 30, 60, 120, 240, 240, ..."""
    return BACKOFF_MINUTES * 2 ** min(attempt - 1, BACKOFF_DOUBLINGS)


def backoff_timers(runs: DataFrame) -> DataFrame:
    """2.14. Job states from a stream of ``runs(job_id, at, ok)``: retries wait on processing-time timers and then become PENDING; needs the RocksDB state store."""
    return runs.groupBy("job_id").transformWithStateInPandas(BackoffTimer(), RETRIES, "Update", "ProcessingTime")


def poll(sources: DataFrame, fetch, path: str, keys: list[str], checkpoint: str, trigger: dict | None = None):
    """2.14. The poll loop: each tick of a stream of due ``sources`` is scanned by ``fetch(batch)``, and notices not stored yet are appended at ``path``."""
    store = append_new(keys, path)
    writer = sources.writeStream.foreachBatch(lambda batch, n: store(fetch(batch), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def failures_by_window(checks: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Failures and checks by source and window, with a watermark."""
    return checks.withWatermark("checked_at", late).groupBy(F.window("checked_at", size), "source_id").agg(F.count_if(~F.col("ok")).alias("failures"), F.count("*").alias("checks"))


def append_new(keys: list[str], path: str):
    """SNK-2, SNK-10 for ``foreachBatch``: append the rows whose key the Parquet table at ``path`` lacks; a batch that is run again adds nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            stored = spark.read.parquet(path).select(*keys)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        rows = fresh if stored is None else fresh.join(stored, keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return sink


def insert_stream(rows: DataFrame, table, checkpoint: str, order: str | None = None, trigger: dict | None = None):
    """SNK-2, SNK-10 on a stream: each batch goes into a ``UniqueTable``, which reads stored rows only where its filters suspect a key."""
    writer = rows.writeStream.foreachBatch(lambda batch, n: table.insert(batch, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_releases(releases: DataFrame, path: str, checkpoint: str):
    """Idempotent ingest of a stream of archive rows (ocid, release_id, ...): whatever has been stored is not stored again."""
    writer = releases.where("ocid is not null").writeStream.foreachBatch(append_new(["ocid", "release_id"], path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
