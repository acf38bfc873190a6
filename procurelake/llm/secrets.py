"""Secret scans (operator 5).

Fixed patterns find the base spans. Beside them, every long run of key-like characters is a candidate: a
window slides over it, its Shannon entropy kept by incremental counts, for each character class on its own;
windows above the class's threshold are merged into spans, which take in the letters and digits next to them. Allow-list patterns that are anchored explain a
whole candidate, others their own characters. Of a span that others overlap, the rest is kept, however short.
Texts are scanned whole; spans count code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, quoted, text_or_empty, unused

#: The base patterns, and the lengths from which their matches count.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``chars`` are candidates; a window of ``width`` counts from ``bits`` on, if it has a character of each of ``needs``."""

    kind: str
    chars: str
    width: int
    bits: float
    needs: tuple[str, ...]


CLASSES = (
    EntropyClass("entropy_hex", "0-9a-fA-F", 20, 3.0, ("0123456789", "abcdefABCDEF")),
    EntropyClass("entropy_key", "A-Za-z0-9+/_=-", 20, 3.7, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
)
#: No secrets: candidates that are identifiers in UUID form or words joined by marks (anchored), placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*$",
    r"(?i)example|placeholder|changeme|dummy|(.)\1{5}",
)


def entropy_windows(text: str, cls: EntropyClass) -> Iterable[tuple[int, int]]:
    """Merged spans of the windows of ``text`` whose entropy reaches the class's threshold.

    The sum of c*log2(c) over the counts c changes by two terms when the window moves on, so a step costs
    constant time: H = log2(width) - sum / width.
    """
    width = cls.width
    if len(text) < width:
        return
    cost = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    kinds = {c: k for k, chars in enumerate(cls.needs) for c in chars}
    present = [0] * len(cls.needs)
    start = end = -1
    for i, c in enumerate(text):
        if i >= width:  # the oldest leaves before the next comes, so that no count passes the width
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += cost[n - 1] - cost[n]
            if (k := kinds.get(old)) is not None:
                present[k] -= 1
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if (k := kinds.get(c)) is not None:
            present[k] += 1
        if i >= width - 1 and all(present) and log2(width) - total / width >= cls.bits - 1e-9:
            if end < i - width + 1:
                if end >= 0:
                    yield start, end
                start = i - width + 1
            end = i + 1
    if end >= 0:
        yield start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind, matches that are too short dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Scanner:
    """Base patterns and entropy classes over one text at a time."""

    def __init__(self, classes: Sequence[EntropyClass], allow: Sequence[str]):
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.width},}}")) for c in classes]
        self.allow = [re.compile(a) for a in allow if a.startswith("^")]
        self.placeholders = [re.compile(a) for a in allow if not a.startswith("^")]
        self.order = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in classes)))}

    def unexplained(self, run: str) -> Iterable[tuple[int, str]]:
        """The parts of a candidate, with their places, between its placeholders; a placeholder explains its own characters and no others."""
        at = 0
        for lo, hi in merged(m.span() for a in self.placeholders for m in a.finditer(run)):
            if at < lo:
                yield at, run[at:lo]
            at = hi
        yield at, run[at:]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = base_spans(text)
        for cls, runs in self.classes:
            added = []
            for run in runs.finditer(text):
                if any(a.search(run.group()) for a in self.allow):
                    continue
                start = run.start()
                for at, part in self.unexplained(run.group()):
                    added += [(start + at + lo, start + at + hi) for lo, hi in merged(widened(part, *span) for span in entropy_windows(part, cls))]
            found += [(cls.kind, *span) for span in uncovered(added, merged((s, e) for _, s, e in found))]
        return sorted(found, key=lambda x: (x[1], self.order[x[0]]))


def widened(part: str, lo: int, hi: int) -> tuple[int, int]:
    """The span with the letters and digits next to it: they belong to one key, though their own windows were a little too even."""
    while lo and part[lo - 1].isalnum():
        lo -= 1
    while hi < len(part) and part[hi].isalnum():
        hi += 1
    return lo, hi


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def uncovered(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterable[tuple[int, int]]:
    """What of each span (in order, apart) no ``taken`` one (likewise) covers; one walk over both."""
    k = 0
    for lo, hi in spans:
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        i = k
        while lo < hi:
            start, end = taken[i] if i < len(taken) else (hi, hi)
            if lo < min(start, hi):
                yield lo, min(start, hi)
            lo, i = max(lo, end), i + 1


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(
    df: DataFrame, text: str = "text", out: str = "secret_spans", *, classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW, drop=()
) -> DataFrame:
    """Append the array of (kind, start, end) found in each whole text, by start and then kind.

    Base kinds overlap freely with one another; of an entropy span the parts that no earlier kind covers are added.
    Null and empty texts have an empty array; repeated rows are scanned each; a column named ``out`` is
    replaced and others pass through; an empty table stays empty. No shuffle.
    """
    classes, allow = tuple(classes), tuple(allow)

    def make():
        scanner = Scanner(classes, allow)

        def compute(texts: pa.Array):
            found = ([{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t.as_py() or "")] for t in texts)
            return [pa.array(list(found), ARROW_SPANS)]

        return compute

    return append_columns(df, [text_or_empty(text)], [T.StructField(out, SPANS)], make, drop=drop)


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with each found span (overlapping ones merged) replaced by ``mask``; rows without spans keep their text, null included.

    All rows and columns stay, whatever the columns' names; repeated rows are masked each; an empty table stays empty.
    """
    name = unused(df, "spans")
    found, own = scan_secrets(df, text, name), F.col(quoted(text))
    cut = F.aggregate(
        name,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(own, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
            .otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    rest = F.concat(cut["done"], F.substring(own, (cut["at"] + 1).cast("int"), F.length(own)))
    masked = F.when(F.size(name) > 0, rest).otherwise(own).alias(text)
    return found.select(*[masked if c == text else F.col(quoted(c)) for c in df.columns])


def spelled(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, digest of their spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, out="found", drop=["text"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
