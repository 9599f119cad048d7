"""Releases and known issues from landed vendor pages (``page_id, url, html``), as sections, headings and table rows.

Every reader fails closed: what does not state its version, build and date
gives no row, and nothing is taken from neighbouring text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.sources import pages as p

_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"


def plain(html: Column) -> Column:
    """Collapsed text of a fragment."""
    return text.collapse(text.strip_tags(html, entities=False))


def day(year: Column, month: Column, number: Column) -> Column:
    """A date from a year, a month's name and a day, or null where there is no such day."""
    return F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.substring(F.initcap(F.lower(month)), 1, 3), number, year), F.lit("MMM d yyyy")))


def first_only(rows: DataFrame, keys: list[str], order: list[str], limit: int | None) -> DataFrame:
    """The first row of each key in page order, at most ``limit`` a page."""
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("page_id", *keys).orderBy(*order))).where("_nth = 1").drop("_nth")
    if limit:
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where(F.col("_nth") <= limit).drop("_nth")
    return rows


def sections(pages: DataFrame, heading: str) -> DataFrame:
    """``page_id, url, nth, title, section``: what each heading that matches owns, up to the next one.

    ``heading`` is a pattern of a whole heading element; the page is split before each of its matches.
    """
    pieces = F.posexplode(F.split("html", f"(?is)(?={heading})", -1)).alias("nth", "section")
    rows = pages.select("page_id", "url", pieces)
    title = plain(F.regexp_extract("section", f"(?is)^({heading})", 1))
    return rows.select("page_id", "url", "nth", title.alias("title"), "section").where("title <> ''")


VERSION_HEADING = r"<h[1-4]\b[^>]*>(?:(?!</h[1-4]>).)*?\b\d{2,4}\.\d{1,3}(?:(?!</h[1-4]>).)*</h[1-4]>"


def release_notes(pages: DataFrame, limit: int | None = None, heading: str = VERSION_HEADING, version: str = r"(\d{2,4}\.\d{1,3}(?:\.\d{1,3})?)", skip: str = r"beta|mobile|ios|android",
                  most: int | None = None, section_chars: int | None = None) -> DataFrame:
    """Releases of a sectioned page: a version heading owns the text up to the next one; beta and mobile headings are passed over.

    ``limit`` bounds the versions, ``section_chars`` what is read of a section, ``most`` what is kept of its text.
    """
    rows = sections(pages, heading).where(~F.lower("title").rlike(skip))
    number = F.regexp_extract("title", version, 1)
    body = plain(F.substring("section", 1, section_chars) if section_chars else F.col("section"))
    body = F.substring(body, 1, most) if most else body
    said = F.concat_ws(" ", "title", body)
    month = F.regexp_extract(said, rf"(?i)\b({_MONTH})\s+(20\d{{2}})\b", 1)
    dated = F.coalesce(p.month_date(F.regexp_replace(said, r"\s+", " ")), day(F.regexp_extract(said, rf"(?i)\b(?:{_MONTH})\s+(20\d{{2}})\b", 1), month, F.lit("1")))
    rows = rows.select("page_id", "url", "nth", "title", number.alias("version"), dated.alias("published_at"), body.alias("body"))
    rows = rows.where("version <> ''").withColumn("record_id", F.concat(F.lit("html:"), "version", F.lit(":"), text.short_hash(F.col("url"), F.col("version"), F.col("title"))))
    return first_only(rows, ["nth"], ["nth"], limit)


# Editions that are not the desktop product, and words of releases that are not stable.
NON_DESKTOP = (
    r"\bPhotoshop\s+(?:web(?:\s+app)?|browser|iPad(?:OS)?|Android|iOS|mobile|Chromebook|Chrome\s?OS|Elements|Express)\b"
    r"|\b(?:on|onto|for|to|in|via)\s+(?:the\s+)?(?:web(?:\s+app)?|browser|iPad(?:OS)?|Android|iOS|mobile|Chromebook|Chrome\s?OS)\b|\(\s*(?:web(?:\s+app)?|iPad(?:OS)?|Android|mobile)\b"
)
UNSTABLE = (
    r"\b(?:beta|alpha|nightly|canary|insider|experimental|pilot|pre[\s._-]*release(?:s)?|prerelease(?:s)?|release[\s._-]+candidate(?:s)?|rc\d?|(?:tech(?:nology)?|developer|dev|release)[\s._-]+preview(?:s)?"
    r"|preview[\s._-]+(?:build|release)s?|in[\s._-]+preview\b|test[\s._-]+build|sneak[\s._-]+peek(?:s)?|early[\s._-]+access(?!\s+to\b)|dev[\s._-]+build)\b"
)
CORE = r"2[0-9]\.\d{1,2}(?:\.\d{1,2})?"


def headed_releases(pages: DataFrame, limit: int | None = None, product: str = "Photoshop", foreign: str = NON_DESKTOP, unstable: str = UNSTABLE, core: str = CORE) -> DataFrame:
    """Releases that a heading alone establishes: one version next to the product's name, no other, and one date.

    ``precision`` is day or month; a heading with several months, or several
    days of one month, is ambiguous and dropped, as one without a date is.
    """
    headings = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))).alias("nth", "raw"))
    rows = headings.select("page_id", "url", "nth", F.regexp_replace(plain(F.col("raw")), "[‐-―−]", "-").alias("title"))
    every = lambda pattern: F.array_distinct(F.regexp_extract_all("title", F.lit(f"(?i){pattern}"), F.lit(1)))
    anchored, bare = every(rf"{product}\s+(?:(?:on\s+)?desktop\s+)?(?:app\s+)?(?:version\s+)?({core})\b"), every(rf"\b({core})\b")
    rows = rows.where(F.col("title").rlike(rf"(?i)\b{product}\b") & ~F.col("title").rlike(f"(?i){foreign}") & ~F.col("title").rlike(f"(?i){unstable}"))
    rows = rows.where((F.size(anchored) == 1) & (F.size(F.array_except(bare, anchored)) == 0)).withColumn("version", F.get(anchored, F.lit(0)))

    parts = lambda pattern, g: F.regexp_extract_all("title", F.lit(f"(?i){pattern}"), F.lit(g))
    full, iso, loose = rf"\b({_MONTH})\s+(\d{{1,2}}),\s+(20\d{{2}})\b", r"\b(20\d{2})-(\d{2})-(\d{2})\b", rf"\b({_MONTH})\s+(20\d{{2}})\b"
    named = F.transform(F.arrays_zip(parts(full, 3).alias("y"), parts(full, 1).alias("m"), parts(full, 2).alias("d")), lambda t: day(t["y"], t["m"], t["d"]))
    written = F.transform(parts(iso, 0), lambda t: F.to_date(F.try_to_timestamp(t)))
    days = F.array_distinct(F.array_compact(F.concat(named, written)))
    months = F.transform(F.arrays_zip(parts(loose, 2).alias("y"), parts(loose, 1).alias("m")), lambda t: day(t["y"], t["m"], F.lit("1")))
    all_months = F.array_distinct(F.array_compact(F.concat(F.transform(days, lambda d: F.trunc(d, "month")), months)))
    rows = rows.withColumns({"_days": days, "_months": all_months}).where((F.size("_months") == 1) & (F.size("_days") <= 1))
    rows = rows.withColumn("published_at", F.coalesce(F.get("_days", F.lit(0)), F.get("_months", F.lit(0)))).withColumn("precision", F.when(F.size("_days") == 1, "day").otherwise("month"))
    return first_only(rows.drop("_days", "_months"), ["version"], ["nth"], limit)


def known_issues(pages: DataFrame) -> DataFrame:
    """Known issues of a status page: the rows of its first table with summary and status; nothing else is read."""
    rows = p.table_rows(pages)
    has = lambda name: F.exists("header", lambda h: F.contains(h, F.lit(name)))
    rows = rows.where(has("summary") & has("status"))
    cell = lambda name: F.coalesce(p.cell(name), F.lit(""))
    rows = rows.select(
        "page_id", "table_no", "row_no", cell("summary").alias("summary"), cell("status").alias("status_raw"), cell("originating").alias("origin"), cell("last updated").alias("last_updated")
    ).where("summary <> '' AND status_raw <> ''")
    firsts = rows.groupBy("page_id").agg(F.min("table_no").alias("table_no"))
    resolved = F.startswith(F.lower(F.trim("status_raw")), F.lit("resolved"))
    kb, build = r"(?i)\b(KB\s?\d{6,7})\b", r"\b(\d{4,5}\.\d{1,5})\b"
    return rows.join(firsts, ["page_id", "table_no"]).select(
        "page_id", "row_no", "summary", "status_raw", F.when(resolved, "resolved").otherwise("active").alias("state"), F.regexp_extract("origin", build, 1).alias("originating_build"),
        F.regexp_extract("origin", kb, 1).alias("originating_kb"), F.when(resolved, F.regexp_extract("status_raw", kb, 1)).otherwise("").alias("resolving_kb"), "last_updated",
        F.regexp_extract(F.concat_ws(" ", "summary", "status_raw"), r"(?i)safeguard\s+id:?\s*(\d+)", 1).alias("safeguard_id"),
    )


def issue_counts(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Active and resolved issues and those with a safeguard's number."""
    return issues.groupBy(*keys).agg(
        F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "resolved").alias("resolved"), F.count_if(F.col("safeguard_id") != "").alias("safeguards"), F.count("*").alias("n")
    )


def with_known_issues(records: DataFrame, issues: DataFrame, key: str = "page_id", most: int = 6) -> DataFrame:
    """Records with counts of their page's issues and a roll-up after their body; records without a page or issues stay as they are.

    The first ``most`` issues are listed, the number of the others is said.
    """
    short = F.when(F.length("summary") <= 220, F.col("summary")).otherwise(F.concat(F.rtrim(F.substring("summary", 1, 219)), F.lit("…")))
    build, kb = F.nullif(F.concat(F.lit("OS Build "), "originating_build"), F.lit("OS Build ")), F.nullif(F.col("originating_kb"), F.lit(""))
    facts = F.concat_ws(
        "; ", F.concat(F.lit("status "), "status_raw"), F.concat(F.lit("originating "), F.coalesce(F.nullif(F.concat_ws(" ", build, kb), F.lit("")), F.lit("N/A"))),
        F.when(F.col("last_updated") != "", F.concat(F.lit("last updated "), "last_updated")), F.when(F.col("resolving_kb") != "", F.concat(F.lit("resolved by "), "resolving_kb")),
        F.when(F.col("safeguard_id") != "", F.concat(F.lit("safeguard ID "), "safeguard_id")),
    )
    line = F.concat(F.lit("- "), F.initcap("state"), F.lit(": "), short, F.lit(" — "), facts, F.lit("."))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("row_no"))
    shown = issues.withColumn("line", line).withColumn("nth", nth).where(F.col("nth") <= most)
    lines = shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    told = issue_counts(issues, [key]).join(lines, key)
    rows = records.join(told, key, "left")
    head = F.format_string("Release health status (official): %d active known issue(s), %d resolved, %d safeguard hold(s).", "active", "resolved", "safeguards")
    rest = F.when(F.col("n") > most, F.concat(F.lit("\n- …and "), (F.col("n") - most).cast("string"), F.lit(" more known issue(s) on the official status page.")))
    rolled = F.concat(F.coalesce("body", F.lit("")), F.lit("\n\n"), head, F.lit("\n"), "lines", F.coalesce(rest, F.lit("")))
    present = (F.col("active") > 0) | (F.col("safeguards") > 0)
    return rows.withColumns({"body": F.coalesce(rolled, "body"), "known_issues_present": present}).drop("lines", "n")


def update_history(pages: DataFrame, channel: str = "Current Channel", limit: int | None = None) -> DataFrame:
    """Versions of an update-history table: rows whose first cell is exactly the channel, with version and build; the first date counts, none is no fault."""
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("nth", "row")).withColumn("cells", cells)
    first = lambda pattern: F.get(F.filter("cells", lambda c: c.rlike(pattern)), F.lit(0))
    rows = rows.where((F.size("cells") >= 4) & (F.lower(F.get("cells", F.lit(0))) == channel.lower()) & ~F.lower(F.get("cells", F.lit(0))).rlike("preview|insider|beta"))
    dates = F.filter(F.transform("cells", p.month_date), lambda d: d.isNotNull())
    rows = rows.select("page_id", "url", "nth", first(r"^\d{4}$").alias("version"), first(r"^\d{4,6}\.\d{4,6}$").alias("build"), F.get(dates, F.lit(0)).alias("published_at"))
    return first_only(rows.where("version IS NOT NULL AND build IS NOT NULL"), ["version"], ["nth"], limit)


SUITE = r"(?i)\b(?:all (?:microsoft 365 )?apps|all office apps|across (?:the )?(?:microsoft 365|office) apps|every (?:microsoft 365|office) app|microsoft 365 apps suite)\b"


def app_notes(pages: DataFrame, app: str, limit: int | None = None) -> DataFrame:
    """Versions of a suite's release notes that say something about one app, or about all.

    A section needs a build and a date; a date without a year gets it from
    the version (year and month), one later if the month is an earlier one.
    """
    rows = sections(pages, r"<h[1-4]\b[^>]*>[^<]*?\bversion\s+\d{3,4}\b[^<]*?</h[1-4]>")
    blocks = F.filter(F.transform(F.regexp_extract_all("section", F.lit(r"(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)>"), F.lit(1)), plain), lambda b: b != "")
    rows = rows.select("page_id", "url", "nth", F.regexp_extract("title", r"(?i)\bversion\s+(\d{3,4})\b", 1).alias("version"), F.regexp_extract("section", r"(?i)build\s+(\d{3,6}\.\d{3,6})", 1).alias("build"),
                       plain(F.col("section")).alias("said"), blocks.alias("blocks"))
    near = rf"(?i)\b({_MONTH})\s+(\d{{1,2}})\b"
    month, number = F.regexp_extract("said", near, 1), F.regexp_extract("said", near, 2)
    valid = F.col("version").rlike(r"^\d{2}(?:0[1-9]|1[0-2])$")
    year = F.when(valid, F.substring("version", 1, 2).cast("int") + 2000)
    guess = day(year.cast("string"), month, number)
    later = F.when(F.month(guess) < F.substring("version", 3, 2).try_cast("int"), day((year + 1).cast("string"), month, number)).otherwise(guess)
    rows = rows.withColumn("published_at", F.coalesce(p.month_date(F.col("said")), later))
    named = F.filter("blocks", lambda b: b.rlike(SUITE) | b.rlike(rf"(?i)(?<![A-Za-z])\Q{app}\E(?![A-Za-z])"))
    rows = rows.withColumn("entries", named).withColumn("suite_wide", F.exists("blocks", lambda b: b.rlike(SUITE)))
    rows = rows.where("version <> '' AND build <> '' AND published_at IS NOT NULL AND size(entries) > 0").select("page_id", "url", "nth", "version", "build", "published_at", "entries", "suite_wide")
    return first_only(rows, ["version"], ["nth"], limit)


#: Words of other platforms, clouds and rings in a caption or row.
FOREIGN = (
    r"(?i)\b(?:mac(?:os)?|web|browser|vdi|mobile|ios|android|linux|gcc|gcch|dod|government|gallatin|sovereign|classic|preview(?:s)?|insider(?:s)?|beta(?:s)?|targeted|release[\s._-]*candidate|test[\s._-]*build"
    r"|pre[\s._-]*release|canary|nightly|dev|tap|rc|early[\s._-]*access|ring)\b"
)


def version_history(pages: DataFrame, cloud: tuple[str, ...] = ("public cloud", "public cloud offerings"), edition: str = "new teams app version", platform: str = "windows", limit: int | None = None) -> DataFrame:
    """Versions of the one table that stands directly under the headings of a cloud, an edition and a platform.

    Headings carry down to the next of their level; a table counts only if
    the heading right before it completes the chain. A row's year carries down
    its table; a version with several dates is dropped.
    """
    units = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<table\b[^>]*>.*?</table>"), F.lit(0))).alias("pos", "raw")
    rows = pages.select("page_id", "url", units).withColumn("level", F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).try_cast("int")).withColumn("said", F.lower(plain(F.col("raw"))))
    page = Window.partitionBy("page_id").orderBy("pos")
    here = page.rowsBetween(Window.unboundedPreceding, 0)
    held = lambda n: F.last(F.when(F.col("level") <= n, F.when(F.col("level") == n, F.col("said")).otherwise("")), True).over(here)
    chain = held(2).isin(*cloud) & (held(3) == edition) & (held(4) == platform)
    rows = rows.withColumn("armed", F.coalesce(chain & (F.lag("level").over(page) == 4), F.lit(False))).where("level IS NULL AND armed")
    rows = rows.where(~F.coalesce(F.lower(plain(F.regexp_extract("raw", r"(?is)<caption\b[^>]*>(.*?)</caption>", 1))).rlike(FOREIGN), F.lit(False)))
    lines = rows.select("page_id", "url", "pos", F.posexplode(F.regexp_extract_all("raw", F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("nth", "row"))
    lines = lines.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)).where("size(cells) > 0")
    stated = F.get(F.filter("cells", lambda c: c.rlike(r"^20\d{2}$")), F.lit(0))
    lines = lines.withColumn("year", F.last(stated, True).over(Window.partitionBy("page_id", "pos").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.where(~F.array_join("cells", " ").rlike(FOREIGN))
    build = F.array_distinct(F.filter("cells", lambda c: c.rlike(r"^\d{2}(?:00[1-9]|0[1-9]\d|[12]\d\d|3[0-5]\d|36[0-6])\.\d{1,6}\.\d{1,6}\.\d{1,6}$")))
    said = F.array_distinct(F.regexp_extract_all(F.lower(F.array_join("cells", " | ")), F.lit(rf"\b(?:{_MONTH})\s+\d{{1,2}}\b"), F.lit(0)))
    lines = lines.withColumns({"builds": build, "days": said}).where("size(builds) = 1 AND size(days) = 1")
    dated = day(F.col("year"), F.regexp_extract(F.get("days", F.lit(0)), r"^(\w+)", 1), F.regexp_extract(F.get("days", F.lit(0)), r"(\d+)$", 1))
    lines = lines.select("page_id", "url", (F.col("pos") * 100_000 + F.col("nth")).alias("nth"), F.get("builds", F.lit(0)).alias("version"), dated.alias("published_at")).where("published_at IS NOT NULL")
    found = lines.groupBy("page_id", "url", "version").agg(F.min("nth").alias("nth"), F.min("published_at").alias("published_at"), F.max("published_at").alias("_last"))
    return first_only(found.where("published_at = _last").drop("_last"), ["version"], ["nth"], limit)


#: Parsers by the name that a source's configuration gives.
PROFILES: dict[str, Callable[..., DataFrame]] = {
    "release_notes": release_notes,
    "adobe_photoshop": headed_releases,
    "microsoft_365_apps_update_history": update_history,
    "microsoft_365_powerpoint_release_notes": partial(app_notes, app="powerpoint"),
    "microsoft_office_app_release_notes": app_notes,
    "microsoft_office_release_notes": update_history,
    "generic": update_history,
    "microsoft_teams_version_history": version_history,
}


def parse(pages: DataFrame, profile: str, **options) -> DataFrame:
    """Rows of a page by its parser profile; an unknown profile is an error."""
    if profile not in PROFILES:
        raise ValueError(f"unknown parser profile {profile!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[profile](pages, **options)


def pattern_version(said: Column, pattern: str, group: str = "version") -> Column:
    """The version that a configured pattern with a named group finds in a text, else null."""
    at = re.compile(pattern).groupindex.get(group, 1)
    return F.nullif(F.regexp_extract(F.coalesce(said, F.lit("")), f"(?i){pattern.replace('(?P<', '(?<')}", at), F.lit(""))
