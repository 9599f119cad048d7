"""Changelogs from landed pages: a listing's links to single entries, and each entry's page as a release.

Listings have ``page_id, product_id, url, html``, entries ``url, html``. A
listing without such links gives nothing, or its own page as a snapshot where
that is allowed. A page without a date has none, and its id is made without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, fixed, text
from ledgerloom.sources import pages as p

LISTING = "page_id bigint, product_id string, url string, html string"


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def entry_link(profile: str = "generic") -> Column:
    """Whether ``link`` (with ``label``, on the page ``url``) leads to a single entry by the rules of a parser profile."""
    path = F.regexp_extract("link", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    if profile in fixed.CHANGELOG_SITES:
        hosts, pattern = fixed.CHANGELOG_SITES[profile]
        return ((_host("link") == "") | _host("link").isin(*hosts)) & F.concat(F.rtrim(path, F.lit("/")), F.lit("/")).rlike(pattern)
    foreign = (_host("link") != "") & (_host("url") != "") & (_host("link") != _host("url"))
    said = F.lower(F.concat(path, F.lit(" "), "label"))
    named = F.exists(F.array(*map(F.lit, fixed.CHANGELOG["entry"])), lambda t: F.contains(said, t))
    return ~foreign & ~path.rlike(fixed.CHANGELOG["no_entry"]) & named


def title(html: Column, loose: bool = True) -> Column:
    """Text of the first h1, else h2, else title element, without the site's name."""
    out = F.lit(fixed.CHANGELOG["untitled"])
    for tag in ("title", "h2", "h1"):
        pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
        out = F.when(html.rlike(pattern), text.strip(F.regexp_replace(text.strip_tags(F.regexp_extract(html, pattern, 1), loose=loose), fixed.CHANGELOG["suffix"], ""))).otherwise(out)
    return out


def body(html: Column, least: int = 80, most: int | None = None, loose: bool = True) -> Column:
    """Text of the article, else of the main part, if it is longer than ``least``, else of the page."""
    out = text.strip_tags(html, loose=loose)
    for tag in ("main", "article"):
        inner = text.strip_tags(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), loose=loose)
        out = F.when(F.length(inner) > least, inner).otherwise(out)
    return F.substring(out, 1, most) if most else out


def dated(html: Column, head: int | None = None, loose: bool = True) -> Column:
    """The first date of a page (of its first ``head`` characters) as ISO text where it is a day, as it stands where it has a month's name; else null."""
    said = F.regexp_extract(text.strip_tags(F.substring(html, 1, head) if head else html, loose=loose), fixed.CHANGELOG["date"], 1)
    return F.when(said != "", dates.normalize(said, F.lit("1970-01-01T00:00:00Z")))


def entries(
    listings: DataFrame, fetched: DataFrame, profile: str = "generic", snapshot: bool = False, links: int | None = None, limit: int | None = None,
    body_chars: int | None = None, head_chars: int | None = None, loose: bool = True,
) -> DataFrame:
    """Records of the entries that listings link to, in their order; with ``snapshot`` one of each listing without such links.

    ``links`` bounds the links of a listing that are followed, ``limit`` its records. Entities without their
    semicolon (``&amp``) are read as HTML does, unless ``loose`` is false.
    """
    found = p.links(listings, entry_link(profile), links)
    once = fetched.groupBy(F.col("url").alias("link")).agg(F.max("html").alias("html"))
    shown = listings.select("page_id", "product_id", F.col("url").alias("official_url"))
    rows = found.join(once, "link").join(shown, "page_id").select("page_id", "nth", "product_id", "official_url", F.col("link").alias("source_url"), "html")
    rows = _records(rows, F.lit("html-changelog"), F.lit("captured-from-official-html"), body_chars, head_chars, loose)
    hashed = text.short_hash(F.col("source_url"), F.col("title"), F.col("published_at"))
    if snapshot:
        alone = listings.join(found.select("page_id").distinct(), "page_id", "left_anti")
        alone = alone.select("page_id", F.lit(1).alias("nth"), "product_id", F.col("url").alias("official_url"), F.col("url").alias("source_url"), "html")
        alone = _records(alone, F.lit("html-changelog-snapshot"), F.lit("captured-from-official-html-snapshot"), body_chars, head_chars, loose)
        rows, whole = rows.unionByName(alone), text.short_hash(F.col("html"))
        hashed = F.when(F.col("source_type") == "html-changelog", hashed).otherwise(whole)
    rows = rows.withColumn("digest", hashed)
    if limit:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("nth"))).where(F.col("_n") <= limit).drop("_n")
    version = F.when(F.col("title") != "", F.col("title")).otherwise(F.when(F.col("source_type") == "html-changelog", F.col("digest")).otherwise(""))
    return rows.select(
        F.concat(F.lit("html:"), "product_id", F.lit(":"), "digest").alias("record_id"), "page_id", "nth", "product_id", version.alias("version"), "title", "published_at",
        "source_url", "official_url", "body", "source_type", "capture_status",
    )


def _records(rows: DataFrame, kind: Column, status: Column, body_chars: int | None, head_chars: int | None, loose: bool) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    made = {"title": title(html, loose), "body": body(html, most=body_chars, loose=loose), "published_at": dated(html, head_chars, loose)}
    return rows.withColumns(made | {"source_type": kind, "capture_status": status})


def read(spark: SparkSession, path: str, details: str, **options) -> DataFrame:
    """Records of landed listings and entries (pages as JSON lines)."""
    return entries(spark.read.schema(LISTING).json(path), spark.read.schema("url string, html string").json(details), **options)
