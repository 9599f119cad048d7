"""Source adapters by name: each reads landed files into release rows, in batches or as a stream; other adapters and collectors may be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources import changelog, feeds
from ledgerloom.sources.landed_source import LandedSource

Adapter = Callable[..., DataFrame]
ADAPTERS: dict[str, Adapter] = {
    "rss_feed": feeds.rss,
    "atom_feed": feeds.atom,
    "github_releases": feeds.releases,
    "vendor_downloads": feeds.downloads,
    "issues": feeds.issues,
    "html_changelog": changelog.read,
    "manual_watch": lambda spark, path="", **_: feeds.empty(spark),
}


def read(spark: SparkSession, adapter: str, path: str, **options) -> DataFrame:
    """Rows of a named adapter; unknown names are an error."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[adapter](spark, path, **options)


def register(name: str, adapter: Adapter) -> None:
    """Add an adapter of one's own; a name that is taken is an error."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name!r} is there already")
    ADAPTERS[name] = adapter


#: What makes releases of landed items, by the kind of the items.
ITEMS: dict[str, Callable[..., DataFrame]] = {"rss_feed": feeds.rss_releases, "atom_feed": feeds.atom_releases, "github_releases": feeds.listed_releases}


def landed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Items of numbered landed files by the data source ``landed``."""
    spark.dataSource.register(LandedSource)
    return spark.read.format("landed").option("kind", kind).load(path)


def landed_stream(spark: SparkSession, kind: str, path: str, progress: str | None = None) -> DataFrame:
    """The same as a stream, whose progress is told to the collector once the sink has it."""
    spark.dataSource.register(LandedSource)
    stream = spark.readStream.format("landed").option("kind", kind)
    return (stream.option("progress", progress) if progress else stream).load(path)


def stream(spark: SparkSession, adapter: str, path: str, progress: str | None = None, **options) -> DataFrame:
    """Releases of a named adapter as a stream over numbered landed files."""
    if adapter not in ITEMS:
        raise ValueError(f"adapter {adapter!r} has no stream; those that have: {', '.join(sorted(ITEMS))}")
    return ITEMS[adapter](landed_stream(spark, adapter, path, progress), **options)


def should_run(enabled: bool, adapter: str, product: str, company: str, source: str | None = None, everything: bool = False) -> bool:
    """Whether a configured source runs: the named one, all but hand-watched ones, or the enabled ones."""
    if source:
        return source in (product, company)
    return adapter != "manual_watch" if everything else enabled
