"""Time helpers.  All instants are ``TIMESTAMP_NTZ`` holding UTC wall time."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F


def ntz(value) -> Column:
    """A ``TIMESTAMP_NTZ`` literal from a datetime, date or ISO string."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def _utc(micros: Column) -> Column:
    """Epoch microseconds → UTC wall time, whatever the session zone."""
    seconds = micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def parse_instant(col: Column) -> Column:
    """ISO-8601 text → UTC instant (offsets honoured, none means UTC); unparsable → null.

    The result does not depend on the session time zone.
    """
    text = F.trim(col)
    zoned = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d.*([Zz]|[+-]\d{1,2}(:?\d{2})?|[A-Za-z]+(/[A-Za-z_]+)?)$")
    return F.when(zoned, _utc(F.unix_micros(F.try_to_timestamp(text)))).otherwise(text.try_cast("timestamp_ntz"))


def trunc_seconds(col: Column) -> Column:
    """Drop fractional seconds, keep the NTZ type."""
    return F.date_trunc("second", col).cast("timestamp_ntz")


def midnight_as_written(col: Column) -> Column:
    """Midnight of the calendar date as written in the text.

    ``2024-03-10T23:30:00-05:00`` → ``2024-03-10 00:00:00``: the time is zeroed
    in the text's own offset and the offset then dropped (converting to UTC
    first would move the date).  Null when the text is not a full date
    (four, two and two digits), alone or followed by a time that parses.
    """
    text = F.trim(col)
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").cast("timestamp_ntz")
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}$") | (text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") & F.try_to_timestamp(text).isNotNull())
    return F.when(whole, day)


def epoch_millis_ntz(col: Column) -> Column:
    """Epoch milliseconds → UTC instant; 0 and null give null (Python truthiness)."""
    # beyond year 9999 there is no instant: null, not a failed job
    return F.when((col != 0) & (F.abs(col) < 253_402_300_800_000), _utc(col * 1000))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` as a double (microsecond precision), whatever the session zone."""
    return (end.cast("timestamp_ntz") - start.cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)").cast("double")
