"""Time buckets aligned as the analytical SQL engines align them, and interval checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets below a month start at Monday 2000-01-03, others at 2000-01-01 (days and months since the epoch).
_ORIGIN_SECONDS, _ORIGIN_MONTH = 10959 * 86400, 2000 * 12
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_INTERVAL = re.compile(r"(\d+) ([a-z]+?)s?", re.IGNORECASE)


def parse_interval(text: str) -> tuple[int, str]:
    """(n, unit) of a text like '2 hours'; ValueError for any other text."""
    m = _INTERVAL.fullmatch(text.strip())
    if not m or m[2].lower() not in _SECONDS | _MONTHS or int(m[1]) < 1:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]), m[2].lower()


def time_bucket(ts: Column, interval: str) -> Column:
    """The start of the bucket that a UTC timestamp falls in."""
    n, unit = parse_interval(interval)
    if unit in _SECONDS:
        width = n * _SECONDS[unit]
        seconds = F.unix_seconds(ts)
        return F.timestamp_seconds(seconds - F.pmod(seconds - _ORIGIN_SECONDS, F.lit(width)))
    width = n * _MONTHS[unit]
    months = F.year(ts) * 12 + F.month(ts) - 1
    first = months - F.pmod(months - _ORIGIN_MONTH, F.lit(width))
    return F.make_date(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")


def as_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
