"""Fields from document text, confidence-gated enrichment, review (OP-D7 to OP-D9, OP-D13, OP-A10, OP-S3)."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.times import DEFAULT_CLOSING_HOUR, SAST
from procurelake.operators.normalize import VERIFIED

#: The patterns of the fields, flattened for Java's regular expressions ((?U): classes are Unicode's).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_WORDS = r"(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(" + "|".join(MONTHS) + r")\s+(\d{4})"
DATE_NUMBERS = r"(?:(\d{4})[-/](\d{1,2})[-/](\d{1,2})|(\d{1,2})[-/](\d{1,2})[-/](\d{4}))"
TIME = r"(?:at\s+)?(\d{1,2})[:h](\d{2})(?:\s*(am|pm))?"
WHEN = rf"(?:{DATE_WORDS}|{DATE_NUMBERS})(?:[\s,]+{TIME})?"
NUMBER = r"(?iU)\b(?:tender|bid|quotation|rfq|rfp|contract)(?:\s+(?:no\.?|number|ref(?:erence)?\.?|#)\s*[:\-]?|\s*[:\-])\s*(?=[A-Z0-9 /\-.]{0,30}\d)([A-Z0-9][A-Z0-9 /\-.]{2,30}[A-Z0-9])"
CLOSING = rf"(?iU)(?:closing|closes?|submission\s+deadline|due)\s*(?:date|time|date\s+and\s+time)?\s*[:\-]?\s*{WHEN}"
BRIEFING = rf"(?isU)((?<![no][nN][- ])(?:compulsory|mandatory)\s+)?(?:site\s+(?:meeting|inspection|briefing)|briefing(?:\s+session)?|clarification\s+meeting).{{0,80}}?{WHEN}"
COMPULSORY = (
    r"(?isU)(?<!non-)(?<!non )(?:compulsory|mandatory).{0,60}(?:briefing|site\s+(?:meeting|inspection))"
    r"|(?:briefing|site\s+(?:meeting|inspection)).{0,60}(?<!non-)(?<!non )(?:compulsory|mandatory)"
)
GRADE = r"(?U)\b([1-9])\s*(CE|GB|ME|EP|EB|SB|SF|SH|SI|SJ|SK|SL|SO|SQ)\b"
GRADE_CONTEXT = r"(?iU)cidb|construction\s+industry\s+development"
LEVEL = r"(?iU)b[\s\-]?bbee\s*(?:status\s*)?(?:level|contributor\s+level)?\s*[:\-]?\s*(?:level\s*)?([1-8])\b"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"(?U)(?:\+27|0)\s?\d{2}[\s\-]?\d{3}[\s\-]?\d{4}\b"
VALUE = r"(?isU)(?:estimated\s+(?:value|cost|amount)|budget|contract\s+value).{0,30}?R\s?([\d\s,.]{4,20})"
NUMBER_TOP, EVIDENCE_CHARS = 2_000, 200
LEAST_VALUE, MOST_VALUE = 1_000, 10_000_000_000
FIELDS = ("tender_number", "closing_at", "briefing_at", "compulsory_briefing", "cidb_grades", "bbee_level", "contact_email", "contact_phone", "value_estimated")


def extracted(value: Column, confidence, evidence: Column) -> Column:
    """Null without a value."""
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.when(value.isNotNull(), F.struct(value.alias("value"), confidence.cast("double").alias("confidence"), F.substring(evidence, 1, EVIDENCE_CHARS).alias("evidence")))


@cache
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII digits that they stand for."""
    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, 0x110000) if chr(c).isdecimal()]
    return "".join(x for x, _ in found), "".join(d for _, d in found)


#: What a text holds, in lower case, where a pattern matches: of each group one word at least.
NEEDED = {
    "closing": (("clos", "submission", "due"),), "briefing": (("site", "briefing", "clarification"),), "near": (("compulsory", "mandatory"), ("site", "briefing")), "level": (("bbee",),),
    "email": (("@",),), "phone": (("0", "+27"),), "value": (("estimated", "budget", "contract"),), "numbered": (("tender", "bid", "quotation", "rfq", "rfp", "contract"),), "grades": (("cidb", "construction"),),
}
#: Stands between the groups of a match, and around matches; no pattern matches it.
MARK, INNER, OTHER = "\x01", "\x02", "\x03"


def starting(first: str, pattern: str) -> str:
    """``pattern``, tried only where one of the characters ``first`` stands: those that its matches can begin with, whatever their case."""
    either = "".join(sorted({c for x in first for c in (x.lower(), x.upper(), "\u017f" if x == "s" else x)}))
    return f"(?=[{either}]){pattern}"


def _needed(name: str) -> Column:
    """Whether the column ``__low`` holds what the pattern ``name`` needs; a plain search is a small part of a pattern's run."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains("__low", F.lit(word)) for word in group]) for group in NEEDED[name]])


def _groups(name: str, pattern: str, n: int) -> Column:
    """The groups of a match, found at once, as a list in which those that took no part are empty; digits are ASCII."""
    listed = F.regexp_replace(name, pattern, MARK.join(f"${i}" for i in range(1, n + 1)))
    return F.when(F.col(name) != "", F.split(F.translate(listed, *_digits()), MARK))


def _parts(name: str, base: int) -> dict[str, Column]:
    """Columns of year, month, day, hour, minute from the column ``name`` with a list of groups, of which the date and time groups start at ``base``."""
    # an empty string that is cast costs an exception
    number = lambda i: F.nullif(F.get(name, F.lit(base + i - 1)), F.lit("")).try_cast("int")
    text = lambda i: F.lower(F.get(name, F.lit(base + i - 1)))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), text(1)).cast("int"), F.lit(0))
    return {
        f"{name}_year": F.coalesce(number(2), number(3), number(8)), f"{name}_month": F.coalesce(month, number(4), number(7)), f"{name}_day": F.coalesce(number(0), number(5), number(6)),
        f"{name}_hour": number(9) + F.when((text(11) == "pm") & (number(9) < 12), 12).otherwise(0), f"{name}_minute": number(10),
    }


def _instant(name: str, untimed: int) -> dict[str, Column]:
    """Columns of the instant (or null) and of whether a time was written; without a time it is at the hour ``untimed``."""
    part = {p: F.col(f"{name}_{p}") for p in ("year", "month", "day", "hour", "minute")}
    timed = F.coalesce((part["hour"] < 24) & (part["minute"] < 60), F.lit(False))
    hour, minute = F.when(timed, part["hour"]).otherwise(untimed), F.when(timed, part["minute"]).otherwise(0)
    at = F.try_make_timestamp(F.when(part["year"] > 0, part["year"]), part["month"], part["day"], hour, minute, F.lit(0), F.lit(SAST))
    return {f"{name}_at": at, f"{name}_timed": timed}


def extract_fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """OP-D7. The documents with one nullable struct (value, confidence, evidence) per field; null and empty texts have none.

    Each pattern runs over the text once, and only where the text has words that it needs; its groups are taken from the short match, all at once. What is used
    more than once is a column, in several steps: one large step is more code than Java compiles, and many times as slow.
    Digits of any script count. All patterns run over the whole text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # the mark is no part of a number, and neither is the character it gives way to
    unmarked = F.replace(t, F.lit(MARK), F.lit(OTHER))
    first = {
        "closing": starting("csd", CLOSING), "briefing": starting("cmsb", BRIEFING), "near": starting("cmsb", COMPULSORY), "level": starting("b", LEVEL),
        "email": EMAIL, "phone": starting("+0", PHONE), "value": starting("ebc", VALUE),
    }
    # other letters that a pattern takes for s or i
    low = {"__low": F.lower(F.replace(F.replace(F.replace(t, F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i")), F.lit("\u0130"), F.lit("i")))}
    found = {f"__{name}": F.when(_needed(name), F.regexp_extract(t, pattern, 0)).otherwise("") for name, pattern in first.items()}
    found |= {
        "__numbered": F.when(_needed("numbered"), F.regexp_replace(unmarked, starting("tbqrc", NUMBER), f"{MARK}$0{INNER}$1{MARK}")),
        "__grades": F.when(_needed("grades") & t.rlike(starting("c", GRADE_CONTEXT)), F.regexp_extract_all(t, F.lit(starting("123456789", GRADE)), F.lit(0))),
    }
    # the texts between the matches are those of even place, the matches, each with its candidate, the others
    split = {
        "__numbered": F.when(F.contains("__numbered", F.lit(MARK)), F.split("__numbered", MARK, -1)), "__closing_": _groups("__closing", CLOSING, 12), "__briefing_": _groups("__briefing", BRIEFING, 13),
        "__amount": F.translate(F.regexp_replace(F.regexp_replace(F.regexp_extract("__value", VALUE, 1), r"(?U)[\s,]", ""), r"\.+$", ""), *_digits()).try_cast("double"),
        "__grades": F.array_sort(F.array_distinct(F.transform("__grades", lambda g: F.regexp_replace(g, r"(?U)\s+", "")))),
        "__level_": F.nullif(F.regexp_extract("__level", LEVEL, 1), F.lit("")),
    }
    candidate = lambda x: F.regexp_replace(F.trim(F.substring_index(x, INNER, -1)), r"\.+$", "")
    cut = {
        "__candidates": F.transform(F.filter("__numbered", lambda x, i: i % 2 == 1), candidate),
        "__lengths": F.transform("__numbered", lambda x, i: F.when(i % 2 == 1, F.length(F.substring_index(x, INNER, 1))).otherwise(F.length(x))),
        **_parts("__closing_", 1), **_parts("__briefing_", 2),
    }
    valid = F.transform("__candidates", lambda x: x.rlike(r"(?U)\d") & (F.length(x) <= 30))
    values = {"__place": F.array_position(valid, F.lit(True)).cast("int"), **_instant("__closing_", DEFAULT_CLOSING_HOUR), **_instant("__briefing_", 0)}
    # what lies before the valid match: the texts between the matches, and the matches before it
    start = F.aggregate(F.slice("__lengths", F.lit(1), 2 * F.col("__place") - 1), F.lit(0), lambda n, x: n + x)
    number = {
        "__number": F.when(F.col("__place") > 0, F.get("__candidates", F.col("__place") - 1)),
        "__number_text": F.when(F.col("__place") > 0, F.substring_index(F.get("__numbered", 2 * F.col("__place") - 1), INNER, 1)),
        "__number_start": F.when(F.col("__place") > 0, start),
        "__before": F.coalesce(F.get("__briefing_", F.lit(0)), F.lit("")) != "",
    }
    match = lambda name: F.nullif(F.col(f"__{name}"), F.lit(""))
    before, amount, near = F.col("__before"), F.col("__amount"), match("near").isNotNull()
    fields = {
        "tender_number": extracted(F.col("__number"), F.when(F.col("__number_start") < NUMBER_TOP, 0.85).otherwise(0.7), F.col("__number_text")),
        "closing_at": extracted(F.col("__closing__at"), F.when(F.col("__closing__timed"), 0.75).otherwise(0.6), match("closing")),
        "briefing_at": extracted(F.col("__briefing__at"), 0.7, match("briefing")),
        "compulsory_briefing": F.when(match("briefing").isNotNull(), extracted(before | near, F.when(before, 0.8).otherwise(0.65), F.substring("__briefing", 1, 120)))
        .otherwise(extracted(F.when(near, F.lit(True)), 0.6, match("near"))),
        "cidb_grades": extracted(F.when(F.size("__grades") > 0, F.col("__grades")), 0.8, F.concat(F.lit("grades ['"), F.array_join("__grades", "', '"), F.lit("']"))),
        "bbee_level": extracted(F.concat(F.lit("Level "), "__level_"), 0.75, match("level")),
        "contact_email": extracted(F.lower(match("email")), 0.9, match("email")),
        "contact_phone": extracted(F.regexp_replace(match("phone"), r"(?U)[\s\-]", ""), 0.8, match("phone")),
        "value_estimated": extracted(F.when(amount.between(LEAST_VALUE, MOST_VALUE), amount), 0.6, F.substring("__value", 1, 120)),
    }
    steps = (low, found, split, cut, values, number)
    for step in (*steps, fields):
        documents = documents.withColumns(step)
    return documents.drop(*{c: None for step in steps for c in step})


def long_form(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, value, confidence, evidence), a row for each field found."""
    entry = lambda f: F.struct(F.lit(f).alias("field"), (F.array_join(F.col(f)["value"], ",") if f == "cidb_grades" else F.col(f)["value"].cast("string")).alias("value"), F.col(f)["confidence"].alias("confidence"), F.col(f)["evidence"].alias("evidence"))
    rows = documents.select(key, F.explode(F.array(*[F.when(F.col(f).isNotNull(), entry(f)) for f in FIELDS])).alias("e"))
    return rows.where("e is not null").select(key, "e.*")


#: The fields that documents may set on a tender, and those whose doubtful values go to review.
ENRICHED = ("closing_at", "briefing_at", "compulsory_briefing", "value_estimated")
REVIEWED = ("closing_at", "value_estimated", "compulsory_briefing")


def enrich(found: DataFrame, current: DataFrame) -> DataFrame:
    """OP-D8. ``found(tender_id, field, value, confidence)`` beside ``current(tender_id, field, value, confidence)``: decision per field.

    APPLY where the found confidence is higher than the current one (nothing counts as 0), and REVIEW too
    where a high-stakes value is below the threshold; of several found values the most confident counts,
    ties to the smaller value.
    """
    best = found.groupBy("tender_id", "field").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", F.hash("value"))).alias("b"))
    best = best.select("tender_id", "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence")).where(F.col("field").isin(*ENRICHED))
    now = current.select("tender_id", "field", F.col("value").alias("old_value"), F.col("confidence").alias("old_confidence"))
    both = best.join(now, ["tender_id", "field"], "left")
    return both.withColumn("apply", F.col("confidence") > F.coalesce("old_confidence", F.lit(0.0))).withColumn("review", F.col("field").isin(*REVIEWED) & (F.col("confidence") < VERIFIED))


def enqueue_reviews(queue: DataFrame, items: DataFrame) -> DataFrame:
    """SNK-7. The items(tender_id, field, ...) with no open review of the same tender and field, one of each."""
    open_ = queue.where("resolved_at is null").select("tender_id", "field").distinct()
    return items.join(open_, ["tender_id", "field"], "left_anti").dropDuplicates(["tender_id", "field"])


def review_order() -> list[Column]:
    """OP-S3. Deadlines first, then the longest waiting."""
    return [F.when(F.col("field") == "closing_at", 0).otherwise(1), F.col("queued_at"), F.col("id")]


def review_depth(queue: DataFrame) -> DataFrame:
    """OP-A10."""
    return queue.where("resolved_at is null").groupBy("field").agg(F.count("*").alias("open"), F.min("queued_at").alias("oldest"))


def resolve_reviews(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-D13. (values to write, queue after): ``decisions(id, action, value, decided_at)`` with approve, correct or reject.

    Approved and corrected values are written with human confidence 1; an approval of an item without a
    value writes nothing and leaves it open, and so does a decision on a resolved item. Of several valid
    decisions on an item the first by time counts, as it would have resolved the item before the others came;
    of those at one time, the first by action and value.
    """
    open_ = queue.where("resolved_at is null")
    both = open_.join(decisions.select("id", "action", F.col("value").alias("given"), "decided_at"), "id")
    value = F.when(F.col("action") == "correct", F.col("given")).when(F.col("action") == "approve", F.col("value"))
    valid = both.withColumn("final", value).where(F.col("action").isin("reject") | (F.col("action").isin("approve", "correct") & F.col("final").isNotNull()))
    valid = valid.groupBy("id").agg(F.min_by(F.struct("tender_id", "field", "action", "final", "decided_at"), F.struct("decided_at", "action", "final")).alias("d")).select("id", "d.*")
    writes = valid.where("action != 'reject'").select("tender_id", "field", F.col("final").alias("value"), F.lit(1.0).alias("confidence"), F.lit("HUMAN_VERIFIED").alias("kind"))
    done = valid.select("id", F.col("decided_at").alias("__at"), F.col("action").alias("__how"))
    after = queue.join(done, "id", "left").withColumn("resolved_at", F.coalesce("resolved_at", "__at")).withColumn("resolution", F.coalesce("resolution", "__how"))
    return writes, after.select(*queue.columns)


def process_documents(documents: DataFrame, known_texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """OP-D9, OP-P21. Fields of the unprocessed ``documents(doc_id, content_hash, digest, text)``, each distinct digest extracted once.

    ``known_texts(digest, text)`` holds the texts of earlier passes.
    """
    todo = documents.where("content_hash is null")
    texts = todo.select("digest", "text").join(known_texts.select("digest", F.col("text").alias("known")), "digest", "left")
    once = texts.groupBy("digest").agg(F.min(F.coalesce("known", "text")).alias("text"))
    return todo.select(key, "digest").join(extract_fields(once), "digest")


def any_field(documents: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in FIELDS])
