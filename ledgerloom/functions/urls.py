"""URL columns: normal forms and the test for a specific report page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(c: Column) -> Column:
    """Trimmed, no trailing slashes, lower case: the key of duplicates."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""))


def canonical_page(c: Column) -> Column:
    """Host in lower case and path only: no query, no fragment, single slashes, none at the end."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[?#].*$", "")
    head, rest = F.lower(F.regexp_extract(text, "^([A-Za-z]+://[^/]*)", 1)), F.regexp_extract(text, "^[A-Za-z]+://[^/]*(.*)$", 1)
    return F.regexp_replace(F.concat(head, F.regexp_replace(rest, "/+", "/")), "/$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^[A-Za-z]+://([^/?#]*)", 1))


def path(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))


def specific_report(c: Column) -> Column:
    """Whether an http(s) URL names one report, by rules of its host, not a search page or a forum's root."""
    h, p, bare = host(c), path(c), F.regexp_replace(path(c), "^/+|/+$", "")
    on = lambda name: F.contains(h, F.lit(name))
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    rule = (
        F.when(on("reddit.com"), F.contains(p, F.lit("/comments/")) & (F.size(F.split(bare, "/")) >= 4))
        .when(on("github.com"), p.rlike(r"/issues/\d+/?$"))
        .when(on("forum.blackmagicdesign.com"), F.endswith(p, F.lit("viewtopic.php")) & c.rlike(r"[?&]t=[^&#]"))
        .when(on("creativecow.net"), p.rlike(r"^/forums/thread/[^/]+/?$"))
        .when(on("learn.microsoft.com"), p.rlike(r"/answers/questions/\d+"))
        .when(on("techcommunity.microsoft.com"), p.rlike(r"/(?:m-p|td-p)/\d+") | ((F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-1)).rlike(r"\d{4,}")))
        .otherwise(~F.regexp_replace(p, "/+$", "").rlike("/(?:search|forums|forum)$") & ~bare.isin("", "forums", "forum"))
    )
    return F.coalesce(c.rlike("(?i)^https?://[^/?#]+") & rule, F.lit(False))
