"""Epoch times as Spark expressions; the present moment is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def civil_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """UTC epoch seconds of a civil date; day 31 of a short month runs into the next. Out of range gives null."""
    ok = month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    first = F.unix_date(F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1)))
    return (first.cast("long") + day - 1) * 86_400 + hour * 3600 + minute * 60 + second


def exif_seconds(text: Column) -> Column:
    """Epoch seconds of ``YYYY:MM:DD HH:MM:SS``; anything else gives null."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})", k), F.lit("")).cast("int")
    return civil_seconds(*[part(k) for k in range(1, 7)])


def ago(at_ms: Column, now_ms: Column) -> Column:
    """Relative phrase, the date from a week on."""
    seconds = F.floor((now_ms - at_ms) / 1000.0 + 0.5).cast("long")
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    whole = lambda n: F.floor(seconds / n)
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60).cast("string"), F.lit(" min ago")))
        .when(seconds < 86_400, many(whole(3600), "hour"))
        .when(seconds < 7 * 86_400, many(whole(86_400), "day"))
        .otherwise(F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd"))
    )


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def hms(at_ms: Column) -> Column:
    """HH:MM:SS in UTC, also before the epoch."""
    second = F.pmod(F.floor(at_ms / 1000.0).cast("long"), F.lit(86_400))
    return F.concat_ws(":", _two(F.floor(second / 3600)), _two(F.floor(second % 3600 / 60)), _two(second % 60))


def duration(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), _two(F.floor(seconds % 3600 / 60)), F.lit("m"), _two(seconds % 60), F.lit("s"))


def day(at_ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(at_ms))


def day_label(at_ms: Column, now_ms: Column) -> Column:
    days = F.datediff(day(now_ms), day(at_ms))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(day(at_ms), "EEEE, MMM d"))
