"""Release feeds from landed files: RSS and Atom, release lists, vendor download lists.

All give the columns of ``schemas.RELEASE``; what a source lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text, versions

ITEM = "title string, link string, description string, encoded string, `content:encoded` string, pubDate string, guid string"
ENTRY = "title string, link array<struct<_href:string>>, summary string, content string, published string, updated string, id string"
RELEASES = (
    "id bigint, tag_name string, name string, body string, draft boolean, prerelease boolean, published_at string, created_at string, html_url string, "
    "assets array<struct<name:string,size:bigint,browser_download_url:string>>"
)


def published(c: Column) -> Column:
    """ISO and RFC-822 dates as UTC timestamps, or the first date that stands in the text; else null."""
    c = text.strip(c)
    zone = F.regexp_replace(F.regexp_replace(c, r"\s+(?:GMT|UTC|Z)$", " +0000"), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(c), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)),
    )


def _limited(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return rows.orderBy(*order).limit(limit) if limit else rows


def rss(spark: SparkSession, path: str, official_url: str = "") -> DataFrame:
    """Items of RSS files."""
    return rss_releases(spark.read.schema(ITEM).option("rowTag", "item").option("mode", "PERMISSIVE").format("xml").load(path), official_url)


def rss_releases(rows: DataFrame, official_url: str = "") -> DataFrame:
    """Releases of items (a batch or a stream): id is guid, link or title; the version is the title."""
    title, link = text.first_known(F.col("title"), F.lit("Untitled update")), text.first_known(F.col("link"), F.lit(official_url))
    body = text.strip_tags(text.first_known(F.col("`content:encoded`"), F.col("encoded"), F.col("description")))
    return rows.select(
        text.first_known(F.col("guid"), link, title).alias("record_id"), title.alias("version"), title.alias("title"), published(F.col("pubDate")).alias("published_at"),
        link.alias("url"), body.alias("body"),
    )


def atom(spark: SparkSession, path: str, official_url: str = "") -> DataFrame:
    """Entries of Atom files."""
    return atom_releases(spark.read.schema(ENTRY).option("rowTag", "entry").option("mode", "PERMISSIVE").format("xml").load(path), official_url)


def atom_releases(rows: DataFrame, official_url: str = "") -> DataFrame:
    """Releases of entries (a batch or a stream)."""
    title = text.first_known(F.col("title"), F.lit("Untitled update"))
    link = text.first_known(F.get("link", F.lit(0))["_href"], F.lit(official_url))
    return rows.select(
        text.first_known(F.col("id"), link, title).alias("record_id"), title.alias("version"), title.alias("title"),
        published(text.first_known(F.col("published"), F.col("updated"))).alias("published_at"), link.alias("url"),
        text.strip_tags(text.first_known(F.col("content"), F.col("summary"))).alias("body"),
    )


def first_matching(items: Column, name: str, needles: tuple[str, ...]) -> Column:
    """The first item that holds the earliest needle in its name; without a hit the first item."""
    holds = lambda n: F.get(F.filter(items, lambda a: F.contains(F.lower(a[name]), F.lit(n.lower()))), F.lit(0))
    return F.coalesce(*[holds(n) for n in needles], F.get(items, F.lit(0)))


def releases(spark: SparkSession, path: str, needles: tuple[str, ...] = (), prereleases: bool = False, checksums: str = "## Checksums") -> DataFrame:
    """Release lists as JSON arrays."""
    return listed_releases(spark.read.schema(RELEASES).option("multiLine", True).json(path), needles, prereleases, checksums)


def listed_releases(rows: DataFrame, needles: tuple[str, ...] = (), prereleases: bool = False, checksums: str = "## Checksums") -> DataFrame:
    """Releases of list items (a batch or a stream): no drafts, prereleases only if asked for; assets by preference; checksums cut off the body."""
    rows = rows.where(~F.coalesce("draft", F.lit(False)))
    if not prereleases:
        rows = rows.where(~F.coalesce("prerelease", F.lit(False)))
    version = F.regexp_replace(text.first_known(F.col("tag_name"), F.col("name")), "^v+", "")
    body, asset = F.coalesce("body", F.lit("")), first_matching(F.col("assets"), "name", needles)
    cut = F.locate(checksums, body)
    return rows.select(
        F.coalesce(F.col("id").cast("string"), version).alias("record_id"), version.alias("version"), text.first_known(F.col("name"), version).alias("title"),
        published(text.first_known(F.col("published_at"), F.col("created_at"))).alias("published_at"), F.col("html_url").alias("url"),
        F.when(cut > 0, F.regexp_replace(F.substring(body, F.lit(1), cut - 1), r"\s+$", "")).otherwise(text.strip(body)).alias("body"),
        F.when(cut > 0, text.strip(F.substring(body, cut, F.length(body)))).otherwise(F.lit("")).alias("checksums"),
        asset["name"].alias("asset_name"), asset["size"].alias("asset_size"), text.asset_size(asset["size"]).alias("file_size"),
    )


def downloads(spark: SparkSession, path: str, family: str, product: str, limit: int | None = None, betas: bool = False) -> DataFrame:
    """Vendor download lists: items of a product family, newest first, one of each version."""
    schema = "downloads array<struct<name:string,releaseNotesTitle:string,numericDate:bigint,relatedFamilies:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("downloads").alias("d")).select("d.*")
    rows = rows.where(F.array_contains("relatedFamilies", family) & F.contains(F.lower(F.concat_ws(" ", "name", "releaseNotesTitle")), F.lit(product.lower())))
    found = F.coalesce(versions.normalize_release(F.col("name"), product), versions.normalize_release(F.col("releaseNotesTitle"), product))
    rows = rows.withColumn("found", found).where("found IS NOT NULL")
    if not betas:
        rows = rows.where("found.channel = 'stable'")
    date = F.coalesce("numericDate", F.lit(0))
    order = [date.desc(), F.coalesce("name", F.lit("")).desc()]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("found.version").orderBy(*order))).where("nth = 1")
    return _limited(rows, order, limit).select(
        F.col("found.version").alias("version"), F.col("found.channel").alias("channel"), F.col("name").alias("title"), F.timestamp_millis(date).alias("published_at")
    )


def issues(spark: SparkSession, path: str, version: str, since: str) -> DataFrame:
    """Issues (no pull requests) created since a day whose title or body names the version exactly; one row per URL."""
    schema = "number bigint, title string, body string, created_at string, html_url string, url string, pull_request string, labels array<struct<name:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("pull_request IS NULL")
    named = versions.mentions(F.concat_ws("\n", "title", "body"), F.lit(version))
    return rows.where(named & (F.to_date(F.substring("created_at", 1, 10)) >= F.lit(since).cast("date"))).dropDuplicates(["html_url"])


def empty(spark: SparkSession) -> DataFrame:
    """The source that yields nothing (watched by hand)."""
    from ledgerloom.schemas import RELEASE

    return spark.createDataFrame([], RELEASE)
