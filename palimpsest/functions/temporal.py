"""Time: liveness, as-of reads, whole days and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def moment(value: str | Column) -> Column:
    """A timestamp literal, or the column as it is."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def readable(text: Column) -> Column:
    """ISO text or an epoch number as a timestamp; null where neither reads."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def first_moment(*columns: Column) -> Column:
    """The first of some text columns that reads as a time."""
    return F.coalesce(*(readable(c) for c in columns))


def quiet_days(last_seen: Column, now: str | Column) -> Column:
    """Whole days gone by, not calendar boundaries; 0 for a null or future time."""
    gone = F.floor((F.unix_micros(moment(now).cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / _DAY)
    return F.greatest(F.coalesce(gone, F.lit(0)), F.lit(0)).cast("long")


def node_as_of(valid_from: Column, as_of: str | Column) -> Column:
    """A record is there once it became true."""
    return valid_from <= moment(as_of)


def edge_live(invalidated_at: Column, as_of: str | Column | None = None, include_invalidated: bool = False) -> Column:
    """An edge counts while it isn't withdrawn; read as of an earlier time, one withdrawn later still counts."""
    if include_invalidated:
        return F.lit(True)
    open_ = invalidated_at.isNull()
    return open_ if as_of is None else open_ | (invalidated_at > moment(as_of))


def within(at: Column, start: str | Column, end: str | Column) -> Column:
    """Half-open: start counts, end doesn't."""
    return (at >= moment(start)) & (at < moment(end))


#: Kinds of calendar window with their unit and days of grace.
PERIODS = (("WEEKLY", "week", 1), ("MONTHLY", "month", 3), ("QUARTERLY", "quarter", 3))


def window_start(unit: str, at: Column) -> Column:
    """Start of the ISO week, month or quarter."""
    return F.date_trunc(unit, at)


def window_shift(unit: str, start: Column, n: Column | int) -> Column:
    """The start n windows later (earlier when negative)."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "week":
        return F.timestamp_add("WEEK", n, start)
    return F.timestamp_add("MONTH", n * (3 if unit == "quarter" else 1), start)


def due(end: Column, grace_days: Column | int, now: str | Column) -> Column:
    """A window is due when its grace has gone by too."""
    grace = F.lit(grace_days) if isinstance(grace_days, int) else grace_days
    return F.timestamp_add("DAY", grace, end) <= moment(now)


def may_repeat(last: Column, now: str | Column, hours: int = 24) -> Column:
    """Never ran, or at least so long ago."""
    return last.isNull() | (F.timestamp_add("HOUR", F.lit(hours), last) <= moment(now))
