"""Release facts from landed HTML pages (``page_id, url, html``): links, sections, table rows, carried headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.fixed import WINDOWS_RELEASE
from ledgerloom.operators.temporal import carry_forward

ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
TOKEN = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<tr\b[^>]*>.*?</tr>|<li\b[^>]*>.*?</li>"


def absolute(base: Column, href: Column) -> Column:
    """An href seen from a page: absolute, host-relative, or relative to the page's folder."""
    root = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^:/])/[^/]*$", "")
    scheme = F.regexp_extract(base, "^([A-Za-z]+:)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
    )


def links(pages: DataFrame, keep: Column, most: int | None = None) -> DataFrame:
    """``page_id, nth, link, label`` of a page's anchors that ``keep`` (of link, label) accepts, distinct, in order."""
    found = pages.select(
        "page_id", "url",
        F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("inner"))).alias("pos", "a"),
    )
    found = found.where("a.href <> '' AND NOT a.href LIKE '#%' AND NOT a.href LIKE 'mailto:%'")
    found = found.select("page_id", "url", "pos", absolute(F.col("url"), F.col("a.href")).alias("link"), text.collapse(text.strip_tags(F.col("a.inner"), entities=False)).alias("label"))
    found = found.where(keep & (F.regexp_replace("link", "/+$", "") != F.regexp_replace("url", "/+$", "")))
    first = found.groupBy("page_id", "link").agg(F.min(F.struct("pos", "label")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("at.pos"))
    first = first.select("page_id", nth.alias("nth"), "link", F.col("at.label").alias("label"))
    return first.where(F.col("nth") <= most) if most else first


def changelog_link(source_host: Column | None = None) -> Column:
    """Links to single entries of a changelog, by path or label."""
    said = F.lower(F.concat_ws(" ", "link", "label"))
    return F.contains(said, F.lit("/changelog/")) | F.contains(said, F.lit("/release-notes/")) | F.contains(said, F.lit("/releases/"))


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, pos, kind, text`` of headings, table rows and list items in page order."""
    raw = F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "raw")
    rows = pages.select("page_id", raw)
    kind = F.when(F.lower("raw").rlike("^<h[1-6]"), "heading").when(F.lower("raw").rlike("^<tr"), "row").otherwise("item")
    return rows.select("page_id", "pos", kind.alias("kind"), text.collapse(text.strip_tags(F.col("raw"), entities=False)).alias("text"))


def carried_releases(pages: DataFrame, track: str, unnamed: str, version: str, date: Column) -> DataFrame:
    """Releases of rows and items that state a version and a date, under the track that their heading set.

    A heading that names a track sets it; one that matches ``unnamed`` clears
    it; a release without track, version or date is dropped. The first of a
    track and version counts.
    """
    rows = tokens(pages)
    named = F.nullif(F.regexp_extract("text", track, 1), F.lit(""))
    heading = F.col("kind") == "heading"
    rows = carry_forward(rows, ("page_id",), ("pos",), F.when(heading, named), "carried", heading & named.isNull() & F.col("text").rlike(unnamed))
    found = rows.where(~heading).select(
        "page_id", "pos", F.coalesce(named, F.col("carried")).alias("track"), F.regexp_extract("text", version, 1).alias("version"), date.alias("published_at"), "text"
    )
    found = found.where("track IS NOT NULL AND version <> '' AND published_at IS NOT NULL")
    first = Window.partitionBy("page_id", F.lower("track"), "version").orderBy("pos")
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def month_date(c: Column) -> Column:
    """The first ``Month d, yyyy`` of a text as a date, else null."""
    return F.try_to_timestamp(
        F.regexp_replace(F.regexp_extract(c, r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}, \d{4})\b", 1), r"^([A-Za-z]{3})[a-z]*\.?", "$1"),
        F.lit("MMM d, yyyy"),
    ).cast("date")


def table_rows(pages: DataFrame) -> DataFrame:
    """``page_id, table_no, row_no, cells, header`` of all table rows; the header is the table's first row in lower case."""
    cells = lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: text.collapse(text.strip_tags(c, entities=False))
    )
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>.*?</table>"), F.lit(0))).alias("table_no", "table"))
    rows = tables.withColumn("rows", F.transform(F.regexp_extract_all("table", F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0)), cells))
    rows = rows.select("page_id", "table_no", F.transform(F.get("rows", F.lit(0)), F.lower).alias("header"), F.posexplode("rows").alias("row_no", "cells"))
    return rows.where("row_no > 0")


def cell(name: str) -> Column:
    """The cell under the first header that holds a name, else null."""
    at = F.array_position(F.transform("header", lambda h: F.contains(h, F.lit(name))), F.lit(True))
    return F.get("cells", (F.nullif(at, F.lit(0)) - 1).cast("int"))


def current_versions(pages: DataFrame, skip: str = "(?i)ltsc|ltsb|long-term") -> DataFrame:
    """Current versions with build, date and KB from a release-information page.

    Only the first table with version and latest build (and no KB column)
    counts; long-term rows are skipped; a KB is taken from the rows of all tables
    that state a build and a KB, where it is the only one of its build.
    """
    rows = table_rows(pages)
    has = lambda name: F.exists("header", lambda h: F.contains(h, F.lit(name)))
    told = lambda pattern: F.coalesce(F.get(F.filter("cells", lambda c: c.rlike(pattern)), F.lit(0)), F.lit(""))
    history = rows.select("page_id", told(r"^\d+\.\d+$").alias("build"), F.regexp_extract(told(r"KB\d+"), r"(KB\d+)", 1).alias("kb")).where("build <> '' AND kb <> ''")
    kb = history.groupBy("page_id", "build").agg(F.min("kb").alias("kb"), F.max("kb").alias("most")).where("kb = most").drop("most")
    now = rows.where(has("version") & has("latest build") & ~has("kb article") & ~has("update type"))
    now = now.select("page_id", "table_no", "row_no", cell("version").alias("version"), cell("latest build").alias("build"), cell("latest revision").alias("revised"), F.coalesce(cell("servicing"), F.lit("")).alias("servicing"))
    now = now.where(F.col("version").rlike(r"^\d{2}H\d$") & F.col("build").rlike(r"^\d+\.\d+$") & ~F.col("servicing").rlike(skip))
    firsts = now.groupBy("page_id").agg(F.min("table_no").alias("table_no"))
    now = now.join(firsts, ["page_id", "table_no"])
    order = Window.partitionBy("page_id", "version").orderBy("row_no")
    now = now.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return now.join(kb, ["page_id", "build"], "left").select("page_id", "version", "build", F.regexp_extract("revised", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("published_at"), F.coalesce("kb", F.lit("")).alias("kb"))


def windows_releases(pages: DataFrame, product_id: str, software: str) -> DataFrame:
    """Records of the current Windows versions: id, version, build, KB, date and the public sentences about them."""
    rows = current_versions(pages).join(pages.select("page_id", "url"), "page_id")
    said = lambda pattern, *cs: F.format_string(pattern.replace("%", "%%").replace("{}", "%s"), *cs)
    kb = F.when(F.col("kb") != "", F.concat(F.lit(" ("), "kb", F.lit(")"))).otherwise("")
    build, day, named = F.concat("build", kb), F.date_format("published_at", "yyyy-MM-dd"), F.concat(F.lit(software + " "), "version")
    on_day = F.when(day.isNotNull(), said(WINDOWS_RELEASE["revised"], day)).otherwise("")
    revised = F.coalesce(F.concat(F.lit(" (revised "), day, F.lit(").")), F.lit("."))
    return rows.select(
        F.concat(F.lit(f"microsoft:{product_id}:"), "version", F.lit(":"), text.short_hash(F.col("url"), F.col("version"), F.col("build"))).alias("record_id"),
        "page_id", "version", named.alias("title"), "build", "kb", "published_at", F.col("url").alias("source_url"),
        F.concat(said(WINDOWS_RELEASE["current"], named, build), on_day, F.lit(WINDOWS_RELEASE["source"])).alias("body"),
        F.concat(said(WINDOWS_RELEASE["summary"], F.col("version"), build), revised).alias("official_summary"),
    )
