"""Calendar points as integers, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000


def day_of(d: Column) -> Column:
    """Days since 1970-01-01 of a date."""
    return F.unix_date(d).cast("long")


def first_day_from(ts: Column) -> Column:
    """The first day whose 00:00 UTC isn't before the instant."""
    micros = F.unix_micros(ts)
    over = F.pmod(micros, F.lit(DAY_MICROS))
    return ((micros - over) / F.lit(DAY_MICROS)).cast("long") + F.when(over > 0, 1).otherwise(0)


def iso_day(day: Column) -> Column:
    """yyyy-MM-dd of a day count."""
    return F.date_from_unix_date(day.cast("int")).cast("string")


def iso_instant(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of microseconds since 1970-01-01 UTC."""
    within = F.pmod(micros, F.lit(DAY_MICROS))
    day = ((micros - within) / F.lit(DAY_MICROS)).cast("int")

    def part(unit: int, size: int, width: int) -> Column:
        return F.lpad(F.pmod(F.floor(within / F.lit(unit)), F.lit(size)).cast("string"), width, "0")

    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"),
        part(1_000_000, 60, 2), F.lit("."), part(1, 1_000_000, 6), F.lit("Z"),
    )
