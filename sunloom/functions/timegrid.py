"""Instants, bins and local days.  Instants are TIMESTAMP with the session zone pinned to UTC."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom.config import BIN_MINUTES
from sunloom.functions.values import col


def instant(c: Column | str) -> Column:
    return col(c).cast("timestamp")


def plain(c: Column | str) -> Column:
    """Zone-free UTC timestamp for output."""
    return col(c).cast("timestamp").cast("timestamp_ntz")


def floor_to(c: Column | str, minutes: int = BIN_MINUTES) -> Column:
    step = F.lit(minutes * 60)
    return F.timestamp_seconds(F.unix_seconds(col(c)) - F.pmod(F.unix_seconds(col(c)), step))


def ceil_to(c: Column | str, minutes: int = BIN_MINUTES) -> Column:
    low = floor_to(c, minutes)
    return F.when(low == col(c), low).otherwise(plus_seconds(low, F.lit(minutes * 60)))


def plus_seconds(c: Column | str, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(col(c)) + (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * 1000000)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / 1e6


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / 60.0


def local(c: Column | str, tz: Column | str) -> Column:
    """Wall clock in the plant's zone (tz is a column or a literal name)."""
    return F.from_utc_timestamp(col(c), tz)


def local_day(c: Column | str, tz: Column | str) -> Column:
    return F.to_date(local(c, tz))


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)


def bin_of_day(wall: Column, minutes: int = BIN_MINUTES) -> Column:
    return F.floor(minute_of_day(wall) / minutes).cast("long")


def minute_key(wall: Column) -> Column:
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm")


def local_range_to_utc(first_day: Column, last_day: Column, tz: Column | str) -> tuple[Column, Column]:
    """Half-open UTC range of the local days first..last."""
    return (
        F.to_utc_timestamp(first_day.cast("timestamp"), tz),
        F.to_utc_timestamp(F.date_add(last_day, 1).cast("timestamp"), tz),
    )


def normal_bin_minutes(c: Column) -> Column:
    """Only 15, 30 and 60 minute bins are allowed; everything else becomes 15."""
    v = c.try_cast("int")
    return F.when(v.isin(15, 30, 60), v).otherwise(F.lit(15))


def grid(start: Column, end: Column, minutes: int = BIN_MINUTES) -> Column:
    """Array of the bin starts in [start, end); empty when end <= start."""
    step = minutes * 60
    a, b = F.unix_seconds(start), F.unix_seconds(end) - step
    return F.when(b >= a, F.transform(F.sequence(a, b, F.lit(step).cast("long")), F.timestamp_seconds)).otherwise(
        F.array().cast("array<timestamp>")
    )


def overlaps(start: Column, end: Column, t0: Column, t1: Column) -> Column:
    return (start < t1) & (end >= t0)


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(F.least(a1, b1), F.greatest(a0, b0)))


def time_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    ov = overlap_seconds(a0, a1, b0, b1)
    zero = F.lit(0.0)
    union = F.greatest(seconds_between(a1, a0), zero) + F.greatest(seconds_between(b1, b0), zero) - ov
    return F.when((ov > 0) & (union > 0), ov / union).otherwise(zero)


def parse_instant(c: Column | str, tz: Column | str, naive_is_local: bool = True) -> Column:
    """Epoch seconds/milliseconds, ISO with or without zone, `dd/MM/yyyy HH:mm[:ss]`; naive text is plant local."""
    s = F.trim(col(c).cast("string"))
    number = s.try_cast("double")
    digits = s.rlike(r"^[0-9]+(\.[0-9]+)?$")
    epoch = F.when(digits & (number >= 1e12), F.timestamp_millis(number.try_cast("long"))).when(
        digits & (number >= 1e9), F.timestamp_seconds(number.try_cast("long"))
    )
    zoned = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(s))
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"), F.try_to_timestamp(s))
    slash = F.when(
        s.rlike(r"^\d\d/\d\d/\d{4} \d\d:\d\d(:\d\d)?$"),
        F.coalesce(
            F.try_to_timestamp(s, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(s, F.lit("dd/MM/yyyy HH:mm"))
        ),
    )
    naive = F.coalesce(iso, slash)
    if naive_is_local:
        naive = F.to_utc_timestamp(naive, tz)
    return F.coalesce(epoch, zoned, naive)
