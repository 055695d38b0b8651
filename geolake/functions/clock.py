"""Service-day clock arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

DAY = 86400
UTC_PLUS_8 = 28800


def hms_to_sec(c) -> Column:
    """'HH:MM' or 'HH:MM:SS' to seconds; null when malformed."""
    p = F.split(_c(c), ":")

    def part(i):
        return F.try_element_at(p, F.lit(i)).try_cast("long")

    return part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0))


def sec_to_hhmm(c) -> Column:
    """Clock label of a second count, wrapping past midnight."""
    s = F.pmod(F.round(_c(c)).cast("long"), F.lit(DAY))
    h = F.floor(s / 3600).cast("string")
    m = F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    return F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(m, 2, "0"))


def day_seconds(t) -> Column:
    """Second of the UTC+8 day of an epoch second."""
    return F.pmod(_c(t) + UTC_PLUS_8, F.lit(DAY)).cast("long")


def date_key(t) -> Column:
    """'yyyy-MM-dd' of the UTC+8 day; independent of the session time zone."""
    days = F.floor((_c(t) + UTC_PLUS_8) / DAY).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd")


def service_elapsed(t, first_dep) -> Column:
    """Seconds since departure, wrapped into one day."""
    return F.pmod(_c(t) - _c(first_dep), F.lit(DAY)).cast("long")
