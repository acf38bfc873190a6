"""The source adapters as Spark data sources: ``notice_source`` for batches, ``due_ticks`` as a stream (SRC-17, 2.14, 2.15).

``spark.read.format("notice_source")`` reads all sources of a registry in parallel, one partition for each
source and month window. Rows are raw records under one schema: what a source yields is kept as it comes, and
an error is the last row of its partition, so that neither the source's earlier records nor other sources are
lost. Filters on source, adapter and window decide which partitions exist (``spark.sql.python.filterPushdown.enabled``).
``to_notices`` maps records with the expressions that the file readers use.

``spark.readStream.format("due_ticks")`` gives each source at each time it falls due. The offsets are times, so
the checkpoint alone says what has been given, and a restart repeats nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from procurelake.schemas import release
from procurelake.sources.feeds import as_notices, parse_feeds, posts_to_notices, sitemap_notices
from procurelake.sources.ocds import release_to_notice

RECORDS = "source_id string, adapter string, window_from date, position long, kind string, url string, payload string, error string"
#: What is constant in a partition, so that a filter on it decides about the partition.
PARTITION_COLUMNS = ("source_id", "adapter", "window_from")
DEFAULT_MINUTES = 1440
STREAM_PARTITIONS = 32

Record = tuple[str, str | None, str]


class Reader(NamedTuple):
    """An adapter: ``windows(options)`` are the first days of its months, or [None]; ``fetch(options, window)`` yields (kind, url, payload)."""

    fetch: Callable[[dict, date | None], Iterator[Record]]
    windows: Callable[[dict], list[date | None]] = lambda options: [None]


def files_at(path: str) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the file, or of the files of the folder in order of their names, in whatever store pyarrow reads."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = store.get_file_info(fs.FileSelector(inner, recursive=True)) if found.type == fs.FileType.Directory else [found]
    for info in sorted((i for i in infos if i.type == fs.FileType.File), key=lambda i: i.path):
        with store.open_input_stream(info.path) as f:
            yield info.path, f.read()


def month_starts(options: dict) -> list[date | None]:
    """SRC-3. The months from ``date_from`` to ``date_to`` if the path names one, else no window."""
    if "{month}" not in options.get("path", ""):
        return [None]
    day, last = date.fromisoformat(options["date_from"]).replace(day=1), date.fromisoformat(options["date_to"])
    out = []
    while day <= last:
        out.append(day)
        day = (day + timedelta(days=31)).replace(day=1)
    return out


def fetch_releases(options: dict, window: date | None) -> Iterator[Record]:
    path = options["path"].replace("{month}", f"{window:%Y-%m}") if window else options["path"]
    for name, data in files_at(path):
        package = json.loads(data)
        url, releases = (package.get("uri") or name, package.get("releases") or []) if isinstance(package, dict) else (name, package)
        for r in releases:
            yield "release", url, json.dumps(r)


BLOCK = re.compile(r"(?s)<(?:\w+:)?(item|entry)\b.*?</(?:\w+:)?\1>")
LOCATION = re.compile(r"(?s)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>")


def fetch_feed(options: dict, window: date | None) -> Iterator[Record]:
    """Entries of feeds, else addresses of sitemaps that hold ``url_filter``; a text that breaks off is an error after what it has."""
    wanted = options.get("url_filter", "tender").lower()
    for name, data in files_at(options["path"]):
        text = data.decode("utf-8", "replace")
        url = options.get("url") or name
        end = 0
        for m in BLOCK.finditer(text):
            end = m.end()
            yield "entry", url, m[0]
        for m in LOCATION.finditer(text):
            end = max(end, m.end())
            if wanted in m[1].lower():
                yield "location", url, m[1]
        if not re.search(r"</(?:\w+:)?(?:rss|feed|urlset|sitemapindex|RDF)>\s*$", text[end:]):
            raise ValueError(f"{name} is no feed or sitemap, or breaks off")


def fetch_posts(options: dict, window: date | None) -> Iterator[Record]:
    for name, data in files_at(options["path"]):
        for post in json.loads(data):
            yield "post", post.get("link") or name, json.dumps(post)


def fetch_bulletins(options: dict, window: date | None) -> Iterator[Record]:
    for name, data in files_at(options["path"]):
        yield "bulletin", name, json.dumps({"format": "pdf_bulletin", "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)})


READERS: dict[str, Reader] = {
    "ocds_api": Reader(fetch_releases, month_starts),
    "generic_sitemap_rss": Reader(fetch_feed),
    "generic_cms": Reader(fetch_posts),
    "pdf_bulletin": Reader(fetch_bulletins),
}

COMPARED = {
    EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}


class SourcePartition(InputPartition):
    def __init__(self, source_id: str, adapter: str, options: dict, window: date | None):
        self.source_id, self.adapter, self.options, self.window = source_id, adapter, options, window

    def passes(self, filters: list[Filter]) -> bool:
        own = dict(zip(PARTITION_COLUMNS, (self.source_id, self.adapter, self.window), strict=True))
        for f in filters:
            value = own[f.attribute[0]]
            if isinstance(f, IsNotNull):
                ok = value is not None
            elif isinstance(f, EqualNullSafe):
                ok = value == f.value
            else:
                ok = value is not None and f.value is not None and COMPARED[type(f)](value, f.value)
            if not ok:
                return False
        return True


class NoticeReader(DataSourceReader):
    def __init__(self, options: dict, readers: dict[str, Reader]):
        self.sources, self.readers, self.filters = json.loads(options.get("sources", "[]")), readers, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (*COMPARED, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in PARTITION_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[SourcePartition]:
        out = []
        for s in self.sources:
            reader, options = self.readers.get(s["adapter"]), s.get("options") or {}
            try:
                windows = reader.windows(options) if reader else [None]
            except Exception:  # the partition meets it again and reports it
                windows = [None]
            out += [SourcePartition(s["source_id"], s["adapter"], options, w) for w in windows]
        return [p for p in out if p.passes(self.filters)]

    def read(self, part: SourcePartition | None) -> Iterator[tuple]:
        if part is None:  # filters have left none
            return
        n = 0
        head = (part.source_id, part.adapter, part.window)
        try:
            if part.adapter not in self.readers:
                raise KeyError(f"no adapter {part.adapter!r}; there are {sorted(self.readers)}")
            for kind, url, payload in self.readers[part.adapter].fetch(part.options, part.window):
                yield (*head, n, kind, url, payload, None)
                n += 1
        except Exception as e:  # whatever a source does wrong is its own error, kept as its last row
            yield (*head, n, "error", None, None, f"{type(e).__name__}: {e}")


def notice_source(extra: dict[str, Reader] | None = None) -> type[DataSource]:
    """The data source to register, with the adapters of ``extra`` beside the built-in ones; a name is taken once."""
    if taken := {*READERS} & {*(extra or {})}:
        raise ValueError(f"adapters {sorted(taken)} are there already")
    readers = READERS | (extra or {})

    class NoticeSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "notice_source"

        def schema(self) -> str:
            return RECORDS

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return NoticeReader(dict(self.options), readers)

    return NoticeSource


def read_sources(spark: SparkSession, sources: list[dict], extra: dict[str, Reader] | None = None) -> DataFrame:
    """SRC-17. The records of ``sources`` ({source_id, adapter, options}), errors among them.

    No sources give no rows; a source that is listed twice is read twice. A task that is run again, after an
    executor was lost, reads its source from the start and nothing else.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(notice_source(extra))
    return spark.read.format("notice_source").option("sources", json.dumps(sources)).load()


def source_errors(records: DataFrame) -> DataFrame:
    """(source_id, adapter, window_from, error, yielded): what went wrong, after how many records."""
    return records.where("kind = 'error'").select("source_id", "adapter", "window_from", "error", F.col("position").alias("yielded"))


def to_notices(records: DataFrame) -> DataFrame:
    """2.15. The records of the built-in kinds as notices; payloads that do not parse, errors and other kinds give none."""
    of = lambda kind: records.where(F.col("kind") == kind)
    parsed = of("release").select("source_id", F.col("url").alias("source_url"), F.from_json("payload", release()).alias("r")).where("r is not null")
    releases = release_to_notice(parsed.select("source_id", "source_url", "r.*"), F.col("source_id"))
    entries = parse_feeds(of("entry").select("source_id", "url", F.col("payload").alias("xml")))
    stubs = sitemap_notices(of("location").select("source_id", F.col("payload").alias("loc")))
    post = "struct<id:bigint,date:string,date_gmt:string,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>>"
    posts = posts_to_notices(of("post").select("source_id", F.from_json("payload", post).alias("p")).where("p is not null").select("source_id", "p.*"), F.col("source_id"))
    file = F.element_at(F.split("url", "/"), -1)
    bulletins = as_notices(of("bulletin").select("source_id", F.col("url").alias("source_url"), file.alias("title"), F.col("payload").alias("raw")))
    out = releases
    for part in (entries, stubs, posts, bulletins):
        out = out.unionByName(part)
    return out


# due sources as a stream


def ticks(frequency_min: int | None, after: int, until: int) -> range:
    """The due times of a source in (after, until], in seconds: the multiples of its interval."""
    step = 60 * (frequency_min if frequency_min and frequency_min > 0 else DEFAULT_MINUTES)
    return range((after // step + 1) * step, until + 1, step)


def due_between(sources: DataFrame, after, until) -> DataFrame:
    """(source_id, due_at) of the due times in (after, until] of ``sources(source_id, frequency_min)``: the batch twin of the stream."""
    step = F.lit(60).cast("long") * F.when(F.col("frequency_min") > 0, F.col("frequency_min")).otherwise(DEFAULT_MINUTES)
    bounds = sources.select("source_id", step.alias("step"), F.unix_timestamp(after).alias("a"), F.unix_timestamp(until).alias("b"))
    first = (F.floor(F.col("a") / F.col("step")) + 1) * F.col("step")
    rows = bounds.withColumn("first", first).where("first <= b").select("source_id", F.explode(F.expr("sequence(first, b, step)")).alias("t"))
    return rows.select("source_id", F.timestamp_seconds("t").alias("due_at"))


class TickPartition(InputPartition):
    def __init__(self, sources: list[dict], after: int, until: int):
        self.sources, self.after, self.until = sources, after, until


def seconds(text: str) -> int:
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


class TickReader(DataSourceStreamReader):
    """Offsets are {"at": seconds}; ``start`` is read when the stream begins for the first time, ``until`` stands for the clock in tests."""

    def __init__(self, options: dict):
        self.options, self.sources = options, json.loads(options.get("sources", "[]"))

    def initialOffset(self) -> dict:
        return {"at": seconds(self.options["start"]) if "start" in self.options else int(time.time())}

    def latestOffset(self) -> dict:
        now = int(time.time())
        return {"at": min(now, seconds(self.options["until"])) if "until" in self.options else now}

    def partitions(self, start: dict, end: dict) -> list[TickPartition]:
        n = max(1, min(STREAM_PARTITIONS, len(self.sources)))
        return [TickPartition(self.sources[i::n], start["at"], end["at"]) for i in range(n)]

    def read(self, part: TickPartition) -> Iterator[tuple]:
        for s in part.sources:
            for t in ticks(s.get("frequency_min"), part.after, part.until):
                yield s["source_id"], datetime.fromtimestamp(t, timezone.utc)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class DueTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "due_ticks"

    def schema(self) -> str:
        return "source_id string, due_at timestamp"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TickReader(dict(self.options))


def due_stream(spark: SparkSession, sources: list[dict], start: str | None = None, until: str | None = None) -> DataFrame:
    """2.14. A stream of (source_id, due_at) of ``sources`` ({source_id, frequency_min}); times without a zone are UTC.

    Each due time is given once for a checkpoint, however often the stream is stopped; what fell due meanwhile is caught up.
    """
    spark.dataSource.register(DueTicks)
    reader = spark.readStream.format("due_ticks").option("sources", json.dumps(sources))
    for name, value in (("start", start), ("until", until)):
        reader = reader.option(name, value) if value else reader
    return reader.load()


def crawl(spark: SparkSession, sources: list[dict], sink, checkpoint: str, start: str | None = None, until: str | None = None, extra: dict[str, Reader] | None = None, trigger: dict | None = None):
    """2.14. The poll loop: the sources due in a batch are read once and ``sink(records, batch_id)`` gets what they yield.

    The driver sees the ids of the due sources, which the registry bounds.
    """
    by_id = {s["source_id"]: s for s in sources}

    def tick(batch: DataFrame, n: int) -> None:
        due = sorted(r.source_id for r in batch.select("source_id").distinct().collect())
        sink(read_sources(batch.sparkSession, [by_id[i] for i in due], extra), n)

    writer = due_stream(spark, sources, start, until).writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
