"""Bands, windows and relative days; the moment of the query is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ages in days at which a new band begins.
BAND_DAYS = (0, 2, 4, 8, 15, 31, 61, 121, 366)


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def age_band(at: Column, now: Column, bounds: tuple[int, ...] = BAND_DAYS) -> Column:
    """Number of the band of an age: 0 is newest and takes future dates, the last one takes nulls."""
    found = F.lit(0)
    for number, low in list(enumerate(bounds))[1:]:
        found = F.when(age_days(at, now) >= low, number).otherwise(found)
    return F.when(at.isNull(), len(bounds) - 1).otherwise(found)


def within_days(at: Column, now: Column, days: float) -> Column:
    """At most ``days`` old; null dates aren't."""
    return F.coalesce(age_days(at, now) <= days, F.lit(False))


def relative_day(text: Column, now: Column) -> Column:
    """The day of `posted today`, `yesterday`, `N days ago` or `N+ days ago`; null for other texts."""
    low = F.lower(text)
    n = F.regexp_extract(low, r"(\d{1,4})\+?\s*days?\s+ago", 1)
    days = F.when(low.contains("today"), 0).when(low.contains("yesterday"), 1).when(n != "", n.try_cast("int"))
    return F.date_sub(F.to_date(now), days)


def open_status(kind: Column, deadline: Column, awarded: Column, cancelled: Column, now: Column) -> Column:
    """open, closed, awarded, cancelled or unknown as of ``now``; never to be stored."""
    return (
        F.when(cancelled, "cancelled").when(awarded, "awarded").when(deadline.isNull(), F.when(kind == "tender", "unknown").otherwise("closed"))
        .when(deadline >= now, "open").otherwise("closed")
    )
