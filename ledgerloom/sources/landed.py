"""Candidates from landed answers of search and listing services, state and configuration files.

A candidate has ``source_type, source_name, source_url, parent_title,
report_title, report_text, source_date``. What was fetched lies in files;
nothing here goes to the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, text, urls
from ledgerloom.operators import publication
from ledgerloom.sources import documents, feeds
from ledgerloom.sources import pages as p

CANDIDATE = ("source_type", "source_name", "source_url", "parent_title", "report_title", "report_text", "source_date")


def _candidate(rows: DataFrame, kind: str, name: Column, url: Column, title: Column, body: Column, date: Column) -> DataFrame:
    title = F.coalesce(title, F.lit(""))
    said = F.trim(F.concat_ws(" ", title, F.coalesce(body, F.lit(""))))
    values = (F.lit(kind), name, F.coalesce(url, F.lit("")), title, title, said, F.coalesce(date.cast("string"), F.lit("")))
    return rows.select(*[v.alias(c) for v, c in zip(values, CANDIDATE)])


def with_hint(candidates: DataFrame, hints: list[str]) -> DataFrame:
    """Candidates that hold one of the hints; without hints all."""
    wanted = [h.strip().lower() for h in hints if h and h.strip()]
    said = F.lower(F.concat_ws(" ", "source_url", "report_title", "report_text"))
    return candidates.where(F.exists(F.array(*map(F.lit, wanted)), lambda h: F.contains(said, h))) if wanted else candidates


def since(candidates: DataFrame, first_day: str | None) -> DataFrame:
    """Candidates of that day or later; undated ones stay."""
    day = F.substring("source_date", 1, 10)
    return candidates.where((F.col("source_date") == "") | (day >= first_day)) if first_day else candidates


_POST = "data struct<children:array<struct<data:struct<title:string,selftext:string,permalink:string,url:string,created_utc:double,subreddit:string>>>>"


def listing(spark: SparkSession, path: str, source_type: str = "reddit_community_report") -> DataFrame:
    """Posts of listing or search answers (JSON)."""
    rows = spark.read.schema(_POST).option("multiLine", True).json(path).select(F.explode("data.children").alias("c")).select("c.data.*")
    url = F.when(F.startswith("permalink", F.lit("/")), F.concat(F.lit("https://www.reddit.com"), "permalink")).otherwise(F.col("url"))
    date = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _candidate(rows, source_type, F.concat(F.lit("r/"), "subreddit"), url, F.col("title"), F.col("selftext"), date)


def feed(spark: SparkSession, path: str, source_type: str, source_name: str, atom: bool = False) -> DataFrame:
    """Entries of a landed search feed (RSS or Atom)."""
    rows = (feeds.atom if atom else feeds.rss)(spark, path)
    return _candidate(rows, source_type, F.lit(source_name), F.col("url"), F.col("title"), F.col("body"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def posts(search: DataFrame, listed: DataFrame, feed_rows: DataFrame, hints: list[str], first_day: str | None = None) -> DataFrame:
    """Search answers, then listings and feeds that hold a hint, since a day; of each URL the earliest source's."""
    sources = [since(s, first_day) for s in (search, with_hint(listed, hints), with_hint(feed_rows, hints))]
    return publication.union_first(*sources, key=urls.normalize_url(F.col("source_url"))).drop("source_rank")


def answers(feeds_by_query: dict[str, DataFrame], first_day: str | None = None) -> DataFrame:
    """One feed a distinct query (in order), of each URL the first query's row with ``matched_query``."""
    wanted: dict[str, tuple[str, DataFrame]] = {}
    for query, rows in feeds_by_query.items():
        if query.strip():
            wanted.setdefault(query.strip().lower(), (query.strip(), rows))
    tagged = [since(rows, first_day).withColumn("matched_query", F.lit(query)) for query, rows in wanted.values()]
    return publication.union_first(*tagged, key=urls.normalize_url(F.col("source_url"))).drop("source_rank")


def thread_links(pages: DataFrame, specific: Column, most: int | None = None) -> DataFrame:
    """``page_id, link``: the first distinct thread URLs of listing pages, canonical."""
    found = p.links(pages, F.lit(True), most=None).withColumn("link", urls.canonical_page(F.col("link"))).where(specific)
    first = found.groupBy("link").agg(F.min(F.struct("page_id", "nth")).alias("at"))
    rows = first.select("at.page_id", "at.nth", "link").orderBy("page_id", "nth")
    return (rows.limit(most) if most else rows).select("page_id", "link")


def threads(pages: DataFrame, source_type: str, source_name: str, most: int | None = None) -> DataFrame:
    """Candidates of landed thread pages (``url, html``): title, text, the first date that stands in it; walled pages give none."""
    said, title = text.collapse(text.strip_tags(F.col("html"), entities=False)), text.html_title(F.col("html"))
    walled = F.lower(said).rlike("captcha|access denied|forbidden") | (said == "")
    date = F.regexp_extract(said, r"\b(20\d{2}-\d{2}-\d{2})\b", 1)
    date = F.when(date != "", date).otherwise(F.coalesce(p.month_date(said).cast("string"), F.lit("")))
    name = F.when(title != "", title).otherwise(F.col("url"))
    return _candidate(pages.where(~walled), source_type, F.lit(source_name), F.col("url"), name, F.substring(said, 1, most) if most else said, date)


def hydrated(ids: DataFrame, topics: DataFrame, released: Column, source_type: str = "adobe_community_bug_report", most: int | None = None) -> DataFrame:
    """Topics (``id, url, title, body, created_at``) of the distinct ids that a search gave (the first ``most``) (``id, nth``), none from before the release."""
    first = ids.where(F.col("id").rlike(r"^\d+$")).groupBy("id").agg(F.min("nth").alias("nth"))
    first = first.orderBy("nth").limit(most) if most else first
    rows = topics.join(first, "id", "left_semi").where((F.coalesce("created_at", F.lit("")) == "") | (F.substring("created_at", 1, 10) >= released))
    made = _candidate(rows, source_type, F.lit("Community"), F.col("url"), F.col("title"), F.col("body"), F.col("created_at"))
    return made.dropDuplicates(["source_url"])


def search_links(spark: SparkSession, path: str) -> DataFrame:
    """Distinct result URLs of landed web-search answers."""
    rows = spark.read.schema("web struct<results:array<struct<url:string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("web.results.url").alias("link")).where("link <> ''").distinct()


def snapshots(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """``original, snapshot_url, stamp``: of landed snapshot indexes (arrays of strings) the first row with a 14-digit stamp of each URL."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows")).select(F.posexplode("rows").alias("nth", "r"))
    stamp = F.get(F.filter("r", lambda x: x.rlike(r"^\d{14}$")), F.lit(0))
    link = F.get(F.filter("r", lambda x: x.rlike("^https?://")), F.lit(0))
    found = rows.select("nth", stamp.alias("stamp"), link.alias("original")).where("stamp IS NOT NULL AND original IS NOT NULL")
    first = found.groupBy("original").agg(F.min_by("stamp", "nth").alias("stamp"))
    return first.select("original", F.concat(F.lit(archive.rstrip("/") + "/"), "stamp", F.lit("/"), "original").alias("snapshot_url"), "stamp")


def seeded(seeds: DataFrame, fetched: DataFrame, records: DataFrame, stored: DataFrame) -> DataFrame:
    """Hand-written seeds (``source_url, version_raw, target_hint, category, verified, source_published_at``) with what was fetched of them, judged for promotion.

    The target is the record of exactly that version, ``future`` or
    ``ambiguous`` by hint, else none; what is stored already is a duplicate.
    """
    held = stored.select(urls.normalize_url(F.col("source_url")).alias("k")).distinct().withColumn("duplicate", F.lit(True))
    dated = records.select(F.col("update_version").alias("version_raw"), F.col("update_published_at").alias("target_release_date")).dropDuplicates(["version_raw"])
    rows = seeds.withColumn("k", urls.normalize_url(F.col("source_url"))).join(held, "k", "left").join(fetched, "source_url", "left").join(dated, "version_raw", "left")
    exact, seen = F.col("target_release_date").isNotNull(), publication.flag(F.col("body_accessed"))
    rows = rows.withColumns(
        {
            "duplicate": publication.flag(F.col("duplicate")), "body_accessed": seen, "exact_match": exact,
            "target_record": F.when(exact, F.col("version_raw")).when(F.col("target_hint").isin("future", "ambiguous"), F.col("target_hint")).otherwise("ambiguous"),
            "date_passes": dates.date_passes(F.col("source_published_at"), F.col("target_release_date")),
            "body_verified": publication.flag(F.col("verified")) | (seen & publication.flag(F.col("duplicate"))),
        }
    ).drop("k")
    rows = rows.withColumn("confidence", F.when(F.col("body_verified") & exact, "high").when(seen & exact, "medium").otherwise("low"))
    return rows.withColumn("judged", publication.promotion()).select("*", "judged.*").drop("judged")


def sweep(links: DataFrame, inspected: DataFrame, budget: int = 12, complete: bool = True) -> DataFrame:
    """Links (``link, nth``) to fetch next: the first that were not inspected; when none is left and the list is complete, from the start again (``wrapped``)."""
    fresh = links.join(inspected.select("link").distinct(), "link", "left_anti")
    none_left = fresh.isEmpty()
    pool = links if none_left and complete else fresh
    return pool.orderBy("nth").limit(budget).withColumn("wrapped", F.lit(none_left and complete))


def swept(inspected: DataFrame, fetched: DataFrame, deferred: DataFrame, ok: bool, most: int = 200) -> DataFrame:
    """The ledger after a run: what was fetched first, then what stood in it (not after a wrap), without deferred links; a failed run leaves it as it was."""
    if not ok:
        return inspected
    old = inspected.withColumns({"round": F.lit(1), "wrapped": F.lit(False)}).select("link", "nth", "round")
    new = fetched.select("link", "nth", F.lit(0).alias("round"))
    if not fetched.where("wrapped").isEmpty():
        old = old.limit(0)
    both = new.unionByName(old).groupBy("link").agg(F.min(F.struct("round", "nth")).alias("at")).join(deferred.select("link"), "link", "left_anti")
    return both.orderBy("at.round", "at.nth").limit(most).withColumn("nth", F.monotonically_increasing_id()).select("link", "nth")


_STATE = "map<string,struct<seen:array<string>,last_run:string,last_error:string,consecutive_failures:int>>"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """``source, seen, last_run, last_error, consecutive_failures`` of state files; bad JSON is an empty state."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"sources {_STATE}", {"mode": "PERMISSIVE"}).alias("s"))
    opened = rows.where("s.sources IS NOT NULL").select(F.explode("s.sources").alias("source", "state"))
    return opened.select("source", F.coalesce("state.seen", F.array().cast("array<string>")).alias("seen"), "state.last_run", "state.last_error", F.coalesce("state.consecutive_failures", F.lit(0)).alias("consecutive_failures"))


_SOURCE = (
    "product_id string, company_id string, company string, software string, enabled string, "
    "ingestion struct<adapter:string,parser_profile:string,official_url:string,secondary_official_url:string,channel:string,target_app:string,version_pattern:string,limit:string>"
)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Configured sources of YAML files: ids, adapter, profile and options; items that are no maps go, unknown fields too."""
    rows = documents.read_yaml_list(spark, path, "sources", _SOURCE)
    return rows.select(
        "product_id", "company_id", "company", "software", (F.lower("enabled") == "true").alias("enabled"), "ingestion.*"
    ).withColumn("limit", F.coalesce(F.col("limit").try_cast("int"), F.lit(2)))


def selected(sources: DataFrame, names: list[str] | None = None, everything: bool = False) -> DataFrame:
    """Sources that run: the named products or companies, all but hand-watched ones, or the enabled ones; names narrow the others."""
    rows = sources.where(F.col("product_id").isin(*names) | F.col("company_id").isin(*names)) if names else sources
    return rows.where(~F.col("adapter").eqNullSafe(F.lit("manual_watch"))) if everything else rows.where(F.coalesce("enabled", F.lit(False)))


def read_method_health(spark: SparkSession, path: str) -> DataFrame:
    """Method-health rows of YAML files (a list, or a map with methods), normalised: counters, texts, known statuses."""
    names = ("product_id", "update_version", "method_id", "source_type", "status", "blocked_reason", "last_run", "notes", *publication.COUNTERS)
    rows = documents.read_yaml_list(spark, path, "methods", ", ".join(f"{n} string" for n in names), strict=True)
    zero = {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in publication.COUNTERS}
    made = rows.withColumns(zero | {"status": buckets.known_status(F.col("status"))})
    return made.withColumns({n: text.normal(F.col(n)) for n in names if n not in publication.COUNTERS and n != "status"})
