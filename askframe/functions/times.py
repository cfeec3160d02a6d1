"""Times and dates as texts: which are readable, when they are, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import plain_text

# The readable forms of a time and of a date.
TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9])\z"
SPOKEN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DAY_MS = 86_400_000


def _real(text: Column) -> Column:
    day = F.substring(text, 1, 10).try_cast("date")
    return day.isNotNull() & (F.substring(text, 1, 4) != "0000")


def instant(text: Column) -> Column:
    """The timestamp of a readable time, null of any other text. The session's zone is UTC."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2"), " ", "T")
    return F.when(text.rlike(TIME) & _real(text), marked.try_cast("timestamp"))


def moment(text: Column, zone: str | None = None) -> Column:
    """The timestamp of a readable time or date; a date is its midnight in UTC, or on the zone's clock."""
    day = F.when(text.rlike(DATE) & _real(text), text.try_cast("timestamp"))
    return F.coalesce(instant(text), F.to_utc_timestamp(day, zone) if zone else day)


def millis(text: Column) -> Column:
    """Milliseconds of what the language's functions read as a time or date: white space around it is left out, digits may be
    of any script, seconds and zone may be missing (then UTC). A double: whole microseconds by a million, times a thousand."""
    plain = plain_text(text)
    clock = F.regexp_replace(F.substring(plain, F.lit(12), F.char_length(plain)), r"(?:Z|[+-].*)\z", "")
    wall = F.concat(F.substring(plain, 1, 10), F.when(F.char_length(plain) > 10, F.concat(F.lit("T"), clock, F.when(F.char_length(clock) == 5, ":00Z").otherwise("Z"))).otherwise("T00:00:00Z"))
    sign, hours, minutes = (F.regexp_extract(F.substring(plain, F.lit(12), F.char_length(plain)), r"([+-])([0-9]{2}):?([0-9]{2})\z", k) for k in (1, 2, 3))
    offset = (F.coalesce(hours.try_cast("bigint"), F.lit(0)) * 60 + F.coalesce(minutes.try_cast("bigint"), F.lit(0))) * F.when(sign == "-", -60_000_000).otherwise(60_000_000)
    at = F.when(plain.rlike(SPOKEN) & _real(plain), F.unix_micros(wall.try_cast("timestamp")))
    return (at - offset) / 1_000_000.0 * 1000.0


def is_date(text: Column) -> Column:
    """Whether a readable text has no time of day."""
    return F.coalesce(F.char_length(plain_text(text)) <= 10, F.lit(False))


def clock_instant(text: Column) -> Column:
    """The moment that a text with a time of day names, to the second; null of a bare date."""
    return F.when(~is_date(text), F.timestamp_seconds(F.floor(millis(text) / 1000.0)))


def written(ms: Column, date_only: Column) -> Column:
    """A time or date text of milliseconds; null outside the years 1 to 9999."""
    inside = ms.between(-62135596800000.0, 253402300799999.0)
    at = F.timestamp_micros(F.when(inside, F.bround(ms * 1000).cast("bigint")))
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000)) != 0
    full = F.when(micros, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(date_only, F.date_format(at, "yyyy-MM-dd")).otherwise(full)


def normal(text: Column) -> Column:
    """A readable time as fixed-width UTC text, which orders as the instants do."""
    return F.date_format(instant(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def to_second(text: Column) -> Column:
    """A readable time as fixed-width UTC text to the second; a date as it is; null of any other text."""
    return F.coalesce(F.date_format(instant(text), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(is_day(text), text))


def is_day(text: Column) -> Column:
    return F.coalesce(text.rlike(DATE) & _real(text), F.lit(False))


def seconds_of_day(at: Column, zone: str) -> Column:
    """Seconds since midnight on a zone's clock, as a double."""
    local = F.from_utc_timestamp(at, zone)
    return (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("double")


def bucket(at: Column, grain: str, zone: str | None = None) -> Column:
    """The label of an instant's hour, day, week (from Monday) or month, in UTC or on a zone's clock (then without Z)."""
    local = F.from_utc_timestamp(at, zone) if zone else at
    return F.date_format(F.date_trunc(grain, local), "yyyy-MM-dd'T'HH:mm:ss" + ("" if zone else "'Z'"))
