"""The timestamp doctrine (OP-T1 to OP-T8, OP-F16 to OP-F20): instants are UTC, wall-clock strings without a zone are South African."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAST = "+02:00"
#: Publish-to-ingest limits and detection targets by triage tier, in minutes.
TIER_SLA = {1: 30, 2: 120, 3: 360, 4: 1440}
TIER_MTTD = {1: 240, 2: 240, 3: 1440, 4: 1440}
DEFAULT_MINUTES = 1440
DEFAULT_CLOSING_HOUR = 11
#: First wait and the attempt from which it stays.
BACKOFF_MINUTES, BACKOFF_DOUBLINGS = 15, 4

_ZONE = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_sentinel(instant) -> Column:
    """OP-T1. Year 0 or 1 stands for a missing date."""
    return F.when(F.year(_c(instant)) > 1, _c(instant))


def claims_utc(text) -> Column:
    """OP-T5. The string ends in Z or a zero offset."""
    return F.trim(_c(text)).rlike(r"(Z|z|\+00:?00)$")


def _normal(text) -> Column:
    """An offset without its colon gets one; the letter between date and time may be small."""
    return F.regexp_replace(F.trim(_c(text)), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")


def parse_iso(text, assume: str = SAST) -> Column:
    """OP-T2, OP-T4. An instant that honours a written offset; without one the ``assume`` zone. Garbage and sentinels give null."""
    has_zone = F.trim(_c(text)).rlike(_ZONE)
    zoned = F.try_to_timestamp(F.concat(_normal(text), F.when(has_zone, F.lit("")).otherwise(F.lit(assume))))
    date_only = F.trim(_c(text)).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    midnight = F.try_to_timestamp(F.concat(F.trim(_c(text)), F.lit("T00:00:00" + assume)))
    return no_sentinel(F.when(date_only, midnight).otherwise(zoned))


def parse_wall_time(text) -> tuple[Column, Column]:
    """OP-T3. (instant, corrected): a claimed UTC is really local wall time and is re-zoned; other offsets are trusted."""
    wrong = claims_utc(text)
    digits = F.regexp_replace(F.trim(_c(text)), r"(Z|z|\+00:?00)$", "")
    instant = F.when(wrong, parse_iso(digits)).otherwise(parse_iso(text))
    return instant, F.coalesce(wrong & instant.isNotNull(), F.lit(False))


def to_sast(instant) -> Column:
    """OP-T6. The local wall-clock time."""
    return F.from_utc_timestamp(_c(instant), SAST)


def looks_date_only(instant) -> Column:
    """OP-T7. Midnight locally or in UTC: a date that was published without a time."""
    day = 86_400_000_000
    micros = F.unix_micros(_c(instant))
    return (F.pmod(micros, F.lit(day)) == 0) | (F.pmod(micros + 2 * 3_600_000_000, F.lit(day)) == 0)


def closing_with_default_hour(instant) -> Column:
    """OP-T8. A date-only closing becomes eleven o'clock local time of that local day."""
    local_day = F.date_trunc("day", to_sast(instant))
    eleven = F.to_utc_timestamp(local_day + F.expr(f"INTERVAL {DEFAULT_CLOSING_HOUR} HOURS"), SAST)
    return F.when(looks_date_only(instant), eleven).otherwise(_c(instant))


def minutes_between(start, end) -> Column:
    """OP-F17, OP-F22."""
    micros = lambda x: F.unix_micros(_c(x).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(6e7)


def by_tier(tier, table: dict[int, int]) -> Column:
    """OP-F18. The tier's minutes, or the default for unknown and null tiers."""
    limits = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(limits, _c(tier).cast("int")), F.lit(DEFAULT_MINUTES))


def backoff_minutes(attempt) -> Column:
    """OP-F16. 15, 30, 60, 120, 240, 240, ..."""
    return (F.lit(BACKOFF_MINUTES) * F.pow(F.lit(2.0), F.least(_c(attempt) - 1, F.lit(BACKOFF_DOUBLINGS)))).cast("int")


def local_label(instant) -> Column:
    """OP-F20."""
    return F.concat(F.date_format(to_sast(instant), "dd MMM yyyy, HH:mm"), F.lit(" SAST"))
