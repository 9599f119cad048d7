"""Date columns: lenient ISO parsing, tri-state gates, staleness, relative dates. Clocks are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def parse_iso(c: Column) -> Column:
    """Timestamp (naive: UTC) of ISO text, or of its first ten characters, else null."""
    text = F.regexp_replace(F.trim(c.cast("string")), "^['\"]+|['\"]+$", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 10)))


def date_passes(source: Column, target: Column) -> Column:
    """Null without a target; false without a valid source or target date; else source day >= target day."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    return F.when(blank(target), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(parse_iso(source).cast("date") >= parse_iso(target).cast("date"), F.lit(False))
    )


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def is_stale(value: Column, now: Column, days: int) -> Column:
    """Unparseable, or at least so many whole days old."""
    return F.coalesce(F.floor((seconds(now) - seconds(value)) / DAY) >= days, F.lit(True))


def near_boundary(moment: Column, start: Column, end: Column) -> Column:
    """Less than a day from the start or the end (an open end is none)."""
    near = lambda b: F.coalesce(F.abs(seconds(moment) - seconds(b)) < DAY, F.lit(False))
    return near(start) | near(end)


def relative_date(text: Column, captured: Column) -> Column:
    """``struct(at, precision)`` for today, yesterday and "N units ago"; months are 30 days, years 365."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = lambda g: F.regexp_extract(lowered, r"(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago", g)
    amount, unit = F.coalesce(F.expr("cast(null as bigint)"), found(1).try_cast("bigint")), found(2)
    each = F.create_map(*[F.lit(x) for pair in (("minute", 60), ("hour", 3600), ("day", DAY), ("week", 7 * DAY), ("month", 30 * DAY), ("year", 365 * DAY)) for x in pair])
    back = lambda s: F.timestamp_micros((F.unix_micros(captured.cast("timestamp")) - s.cast("bigint") * 1_000_000).cast("bigint"))
    precision = F.when(unit.isin("minute", "hour"), "instant").when(unit.isin("day", "week"), "day").otherwise("coarse")
    make = lambda at, p: F.struct(at.alias("at"), p.alias("precision"))
    return (
        F.when(F.contains(lowered, F.lit("today")), make(captured.cast("timestamp"), F.lit("day")))
        .when(F.contains(lowered, F.lit("yesterday")), make(back(F.lit(DAY)), F.lit("day")))
        .when(unit != "", make(back(amount * F.try_element_at(each, unit)), precision))
    )


def since(today: Column, days: int) -> Column:
    """The day so many days ago, today if negative."""
    return F.date_sub(today.cast("date"), max(0, days))


def normalize(c: Column, now: Column) -> Column:
    """A feed's date as ISO text in UTC: ISO with Z as it is, RFC 822 converted, a day within the text at midnight, else the text; blank is now."""
    text = F.trim(F.coalesce(c, F.lit("")))
    mail = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm Z")),
    )
    day = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(text == "", iso(now.cast("timestamp"))).when(text.rlike("T.*Z$"), text).when(mail.isNotNull(), iso(mail))
        .when(day != "", F.concat(day, F.lit("T00:00:00Z"))).otherwise(text)
    )
