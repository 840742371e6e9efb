"""Dates and durations as Column builders; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

#: Accepted formats, day before month where both could hold.
FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
]
#: Seconds of the units of relative dates, in English and French; a month is 30 days, a year 365.
UNITS = {
    "second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000,
    "seconde": 1, "heure": 3600, "jour": 86400, "semaine": 604800, "mois": 2592000, "an": 31536000, "année": 31536000,
}
#: Beginnings of the names of months, in English and French.
MONTHS = ["jan", "feb|f[eé]v", "mar", "apr|avr", "may|mai", "jun|juin", "jul|juil", "aug|ao[uû]t", "sep", "oct", "nov", "dec|déc"]


def relative_time(x: Column, now: Column) -> Column:
    """"5 days ago", "il y a 3 semaines", "hier", "just now"; null if nothing says when."""
    low = F.lower(x)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    p = rf"(?U)\b(\d+)\+?\s*({units})s?\b"
    table = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    back = F.regexp_extract(low, p, 1).try_cast("bigint") * F.try_element_at(table, F.regexp_extract(low, p, 2))
    ago = lambda seconds: F.timestamp_seconds(F.unix_timestamp(now) - seconds)
    return F.when(low.rlike("just now|moments ago|à l'instant|today|aujourd|hui"), now).when(low.rlike("yesterday|hier"), ago(F.lit(86400))).when(back.isNotNull(), ago(back))


def parse_timestamp(x: Column, now: Column) -> Column:
    """UTC time: epoch seconds or milliseconds, one of the formats, or relative text; null out of 2000 .. now + 400 days."""

    def parsed(t: Column) -> Column:
        digits = F.when(t.rlike(r"^\d{9,14}$"), t.try_cast("double"))
        epoch = F.timestamp_seconds(F.when(digits > 1e11, digits / 1000).otherwise(digits))
        named = F.regexp_replace(t, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,\s*", "")
        formats = let(named, lambda n: F.coalesce(*[F.try_to_timestamp(n, F.lit(f)) for f in FORMATS]))
        return F.coalesce(epoch, formats, relative_time(t, now))

    near = lambda got: F.when((got >= F.lit("2000-01-01").cast("timestamp")) & (F.unix_timestamp(got) <= F.unix_timestamp(now) + 400 * 86400), got)
    return let(let(F.trim(x), parsed), near)


def posted_date(x: Column, now: Column) -> Column:
    """``parse_timestamp`` of a posting: null if more than two days ahead."""
    at = parse_timestamp(x, now)
    return F.when(F.unix_timestamp(at) <= F.unix_timestamp(now) + 2 * 86400, at)


def parse_point(x: Column) -> Column:
    """struct(year, month) of a partial date; month 0 is unknown; null if there is none."""

    def month_of(low: Column) -> Column:
        month = F.lit(0)
        for i, p in reversed(list(enumerate(MONTHS, 1))):
            month = F.when(low.rlike(rf"\b({p})"), i).otherwise(month)
        slashed = F.regexp_extract(low, r"\b(0?[1-9]|1[0-2])\s*/\s*(?:19[5-9]\d|20[0-4]\d)\b", 1)
        return let(slashed, lambda s: F.when(s != "", s.try_cast("int")).otherwise(month))

    def point(low: Column) -> Column:
        year = F.regexp_extract(low, r"\b(19[5-9]\d|20[0-4]\d)\b", 1)
        return let(year, lambda y: F.when(y != "", F.struct(y.cast("int").alias("year"), month_of(low).alias("month"))))

    return let(F.lower(F.coalesce(x, F.lit(""))), point)


def duration_months(start: Column, end: Column) -> Column:
    """Inclusive months between two points; whole years where a month is unknown, at least one."""
    years = (F.greatest(end["year"] - start["year"], F.lit(1)) * 12).cast("int")
    exact = ((end["year"] - start["year"]) * 12 + end["month"] - start["month"] + 1).cast("int")
    return F.when(start.isNull() | end.isNull(), F.lit(None)).when((start["month"] == 0) | (end["month"] == 0), years).when(exact > 0, exact)


def format_months(n: Column, lang: Column) -> Column:
    """'1 year 3 months' or '1 an 3 mois'."""
    y, m = F.floor(n / 12).cast("int"), (n % 12).cast("int")
    fr = lang == "fr"
    ys = F.when(y == 0, F.lit(None)).otherwise(F.concat(y.cast("string"), F.when(fr, F.when(y > 1, " ans").otherwise(" an")).otherwise(F.when(y > 1, " years").otherwise(" year"))))
    ms = F.when(m == 0, F.lit(None)).otherwise(F.concat(m.cast("string"), F.when(fr, F.lit(" mois")).otherwise(F.when(m > 1, " months").otherwise(" month"))))
    return F.when(n > 0, F.concat_ws(" ", ys, ms))
