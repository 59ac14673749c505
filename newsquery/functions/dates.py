"""Dates: parsing of the formats that feeds use, windows, buckets, ages. Nothing here reads the clock."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of published dates, tried in turn.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy", "MMM d, yyyy")
# Window presets in hours.
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "today": 24, "48h": 48, "2d": 48, "7d": 168, "30d": 720, "month": 720, "3m": 2160, "90d": 2160, "12m": 8760, "365d": 8760, "year": 8760}
# The bucket that suits a window; 1d for all others.
BUCKETS = {"1h": "1h", "6h": "1h", "24h": "1h", "today": "1h", "48h": "1h", "2d": "1h", "7d": "1d", "30d": "1d", "month": "1d", "3m": "1w", "90d": "1w", "12m": "1m", "365d": "1m", "year": "1m"}
#: How far in the future a published date may lie before it counts as wrong.
FUTURE_HOURS = 48


def window_hours(window: str) -> int:
    return WINDOWS.get(window.lower(), 8760)


def recommended_bucket(window: str) -> str:
    return BUCKETS.get(window.lower(), "1d")


def periods(as_of: datetime, window: str) -> tuple[datetime, datetime]:
    """(start of the period before, start of the period that ends at ``as_of``)."""
    width = timedelta(hours=window_hours(window))
    return as_of - 2 * width, as_of - width


def bucket_key(ts: Column, bucket: str) -> Column:
    """The bucket of a time as text: hour, day, ISO week or month."""
    if bucket == "1h":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if bucket == "1w":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))
    return F.date_format(ts, "yyyy-MM" if bucket == "1m" else "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """The first format that fits; null for none. Texts without a zone are UTC."""
    t = F.trim(F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, ", ""))  # the day of the week says nothing more
    t = F.regexp_replace(t, "(?i) (gmt|utc)$", " +0000")
    t = F.regexp_replace(t, "([0-9])Z$", "$1+00:00")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in FORMATS))


def parse_warning(text: Column) -> Column:
    """What is wrong with a date, or null."""
    return F.when(text.isNull() | (F.trim(text) == ""), "Missing published date").when(parse_timestamp(text).isNull(), F.concat(F.lit("Unparseable date: "), text))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(ts: Column, as_of: Column) -> Column:
    """Hours before ``as_of``, a tenth at least."""
    seconds = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1_000_000.0)
    return F.greatest(seconds / 3600.0, F.lit(0.1))


def relative_time(ts: Column, as_of: Column) -> Column:
    """How long ago, in words: just now, minutes, hours, days, then the date."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    said = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(mark))
    return F.when(seconds < 60, "just now").when(seconds < 3600, said(60, "m ago")).when(seconds < 86400, said(3600, "h ago")).when(seconds < 604800, said(86400, "d ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def in_range(text: Column, url: Column, start: date, end: date) -> Column:
    """Whether a date lies in the range; if it can't be read, whether a year in the address does; if there is none, yes."""
    day = parse_timestamp(text).cast("date")
    years = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int"))
    by_url = F.when(F.size(years) > 0, F.exists(years, lambda y: y.between(start.year, end.year))).otherwise(F.lit(True))
    return F.when(day.isNotNull(), day.between(F.lit(start), F.lit(end))).otherwise(by_url)


def range_in_words(question: str, as_of: datetime) -> tuple[date, date] | None:
    """The days that a question speaks of: yesterday, today, this month, last week, last 30 days, or "august 1 to 7"."""
    q, today = question.lower(), as_of.date()
    if "yesterday" in q:
        return today - timedelta(days=1), today - timedelta(days=1)
    if "today" in q:
        return today, today
    if "this month" in q:
        return today.replace(day=1), today
    for phrases, days in ((("last week", "past week", "last 7 days"), 7), (("last 30 days", "past month"), 30)):
        if any(p in q for p in phrases):
            return today - timedelta(days=days), today
    names = {n.lower(): i for i, n in enumerate(calendar.month_name) if n} | {n.lower(): i for i, n in enumerate(calendar.month_abbr) if n} | {"sept": 9}
    month = "|".join(sorted(names, key=len, reverse=True))
    found = re.search(rf"({month})\s+(\d{{1,2}})\s*(?:to|-|until)\s*(?:({month})\s+)?(\d{{1,2}})", q)
    if not found:
        return None
    first, second = names[found[1]], names[found[3] or found[1]]
    try:
        return date(today.year, first, int(found[2])), date(today.year, second, int(found[4]))
    except ValueError:
        return None
