"""Times, ages and counts as Columns. The session's time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.text import lower_squash


def parse_ts(c: Column) -> Column:
    """Epoch seconds, ISO 8601 (naive is UTC) or RFC 2822 text as a timestamp, else null."""
    c = F.trim(c)
    epoch = F.when(c.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c).try_cast("double")))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c).try_cast("timestamp")
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC?|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(epoch, iso, mail)


# Units of relative times, by what they begin with, in seconds.
_AGE = r"(\d+)\s*(min(?:uto)?s?|minutes?|m|horas?|hours?|h|d[ií]as?|days?|semanas?|weeks?)(?![\p{L}\p{N}_])"
_UNITS = {"m": 60, "h": 3600, "d": 86400, "s": 604800, "w": 604800}


def relative_age_seconds(c: Column) -> Column:
    """Age told by words such as "hace 12 minutos", "3 h" or "just now", else null."""
    c = lower_squash(c)
    n = F.nullif(F.regexp_extract(c, _AGE, 1), F.lit("")).try_cast("long")
    unit = F.substring(F.regexp_extract(c, _AGE, 2), 1, 1)
    size = F
    for start, seconds in _UNITS.items():
        size = size.when(unit == start, seconds)
    return F.when(c.isin("ahora", "just now", "moments ago"), F.lit(0).cast("long")).otherwise(n * size)


def within_hours(published: Column, fresh: Column, now: Column, hours: int = 48) -> Column:
    """Whether a listing is at most ``hours`` old: by its flag, words, a relative or an absolute time.

    A time up to five minutes ahead counts; what tells no time doesn't.
    """
    said = F.lower(F.trim(F.coalesce(published, F.lit(""))))
    pattern = r"(\d+)\s*(minutes?|minutos?|mins?|m|hours?|horas?|hrs?|h|days?|d[ií]as?|d)"
    n = F.nullif(F.regexp_extract(said, pattern, 1), F.lit("")).try_cast("long")
    unit = F.substring(F.regexp_extract(said, pattern, 2), 1, 1)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.when(published.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), parse_ts(published)))
    iso = said.rlike(r"^\d{4}-\d{2}-\d{2}")
    told = F.when(said.isin("just now", "ahora", "today", "hoy", "yesterday", "ayer"), True)
    told = told.when(~iso & n.isNotNull(), F.when(unit == "m", n <= hours * 60).when(unit == "h", n <= hours).otherwise(n * 24 <= hours))
    return F.coalesce(fresh, F.lit(False)) | F.coalesce(told.otherwise(age.between(-300, hours * 3600)), F.lit(False))


def published_age_seconds(c: Column, now: Column) -> Column:
    """Age of a publication time that has a clock part, at least 0; null without one."""
    return F.when(c.rlike(r"[T ]\d{2}:\d{2}"), F.greatest(F.unix_timestamp(now) - F.unix_timestamp(parse_ts(c)), F.lit(0)))


def nonneg_int(c: Column) -> Column:
    """A count: what isn't a number or is negative becomes 0."""
    return F.greatest(F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0)), F.lit(0))
