"""Lenient date parsing and the defaults for missing dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.catalog import DAY_MS, HOUR_MS

#: Layouts tried in order, after a leading weekday is dropped: RFC 822 with offset, ISO forms, long dates.
LAYOUTS = (
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy",
)

#: Zone names of RFC 822, which stand for one offset in summer and winter: fixed values.
ZONES = (("GMT|UTC|UT|Z", "+0000"), ("EST|CDT", "-0500"), ("EDT", "-0400"), ("CST|MDT", "-0600"), ("MST|PDT", "-0700"), ("PST", "-0800"))


def parse_ms(c: Column) -> Column:
    """Epoch milliseconds of a date in any of the layouts; null where none fits."""
    s = F.regexp_replace(F.trim(c), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    for names, offset in ZONES:
        s = F.regexp_replace(s, rf"\s(?:{names})\z", " " + offset)
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(s, F.lit(x)) for x in LAYOUTS]))


def ms_or_default(ms: Column, order: Column, now_ms: int) -> Column:
    """A missing date is a day ago and an hour earlier for each place in the list."""
    return F.coalesce(ms, F.lit(now_ms - DAY_MS) - order * HOUR_MS)


def path_ms(year: Column, month: Column, day: Column, emitted: Column) -> Column:
    """Noon of a date in an address, a minute earlier for each story already emitted."""
    return F.unix_millis(F.try_make_timestamp(year, month, day, F.lit(12), F.lit(0), F.lit(0))) - emitted * 60_000
