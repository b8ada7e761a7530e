"""Time conversions. Event times are UTC; the session time zone is pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since the epoch; finer digits are dropped."""
    return F.unix_millis(ts.cast("timestamp"))


def millis_to_time(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def window_start(ms: Column, size_ms: int) -> Column:
    """Start of the tumbling window holding ``ms``, both in epoch milliseconds."""
    return ms - F.pmod(ms, F.lit(size_ms))


def event_date(ts: Column) -> Column:
    """Partition value ``yyyy-MM-dd``."""
    return F.date_format(ts, "yyyy-MM-dd")


# Fixed pattern: date, space or T, time, optional fraction, optional Z.
EVENT_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z?$"


def parse_event_time(text: Column) -> Column:
    """Event time from text with or without the `` UTC`` suffix; null when not a time."""
    plain = F.replace(text, F.lit(" UTC"), F.lit(""))
    return F.when(plain.rlike(EVENT_TIME_PATTERN), plain.try_cast("timestamp"))


def parse_replay_time(text: Column) -> Column:
    """The wider set of layouts a replay file may hold: suffix form or ISO 8601."""
    trimmed = F.trim(text)
    return F.coalesce(parse_event_time(trimmed), trimmed.try_cast("timestamp"))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
