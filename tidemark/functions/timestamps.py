"""Timestamp normalisation and the start of the next read."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The formats, defaults and safety window every consumer agrees on.
DISPLAY_PATTERN = "MMM d, yyyy @ HH:mm:ss.SSS"
EPOCH_DISPLAY = "Jan 1, 1970 @ 00:00:00.000"
EPOCH_ISO = "1970-01-01T00:00:00Z"
SAFETY_SECONDS = 30

_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"
_EPOCH = datetime(1970, 1, 1)


def as_bound(value, data_type=T.TimestampType()) -> Column:
    """A constant of the column's own type, so that a comparison with it reaches the scan.

    Takes epoch microseconds, a datetime (naive means UTC), an ISO text in UTC, a Column or None.
    """
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(value, int):
        value = _EPOCH + timedelta(microseconds=value)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    text = value.rstrip("Z")
    if isinstance(data_type, T.TimestampType):
        text += "Z"
    return F.lit(text).cast(data_type)


def epoch(data_type=T.TimestampType()) -> Column:
    return as_bound(0, data_type)


def exact_text(ts: Column, data_type) -> Column:
    """A text that :func:`as_bound` turns back into the same value, whatever the session zone."""
    return iso_text(ts) if isinstance(data_type, T.TimestampType) else ts.cast("string")


def micros(ts: Column) -> Column:
    """Epoch microseconds; a zone-less timestamp is read as UTC under a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def from_display(text: Column, zone: str = "UTC") -> Column:
    """The instant of a display text in ``zone``; null when the text is not of that form."""
    return F.try_to_timestamp(F.concat(text, F.lit(f" {zone}")), F.lit(f"{DISPLAY_PATTERN} VV"))


def from_iso(text: Column) -> Column:
    """The instant of a full ISO-8601 UTC text; null for anything shorter or malformed."""
    return F.when(text.rlike(_ISO_SHAPE), F.try_to_timestamp(text))


def to_instant(text: Column, zone: str = "UTC") -> Column:
    """Display text, else ISO text, else the epoch (also for null and empty)."""
    return F.coalesce(from_display(text, zone), from_iso(text), epoch())


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC with no, three or six fraction digits, whichever is enough."""
    full = F.date_format(_utc_clock(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = F.regexp_replace(F.regexp_replace(full, r"\.000000$", ""), r"(\.\d{3})000$", "$1")
    return F.concat(short, F.lit("Z"))


def display_text(ts: Column, zone: str = "UTC") -> Column:
    """Display form of an instant on the clock of ``zone`` (milliseconds, cut not rounded)."""
    clock = _utc_clock(ts)
    if zone != "UTC":
        clock = F.convert_timezone(F.lit("UTC"), F.lit(zone), clock)
    return F.date_format(clock, DISPLAY_PATTERN)


def to_display(text: Column, zone: str = "UTC") -> Column:
    """ISO text to display text; display text is kept; anything else is the epoch's text."""
    return F.coalesce(
        display_text(from_iso(text), zone),
        F.when(from_display(text, zone).isNotNull(), text),
        F.lit(EPOCH_DISPLAY),
    )


def _utc_clock(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts.cast("timestamp")), F.lit("1970-01-01").cast("timestamp_ntz"))


def effective_start(query_start: Column, last_ts: Column) -> Column:
    """Where the interrupted read began, else the last processed time."""
    return F.coalesce(query_start, last_ts)


def safe_start(query_start: Column, last_ts: Column) -> Column:
    """The effective start, but never later than the last processed time, so nothing is skipped."""
    return F.least(last_ts, effective_start(query_start, last_ts))


def back_off(start: Column, seconds: int = SAFETY_SECONDS) -> Column:
    """Start a little earlier, to meet events that arrived late."""
    return start - F.expr(f"INTERVAL {int(seconds)} SECONDS")
