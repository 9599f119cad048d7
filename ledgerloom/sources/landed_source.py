"""Landed answers of release sources as a data source of Spark, for batches and streams: ``spark.read.format("landed")``.

A collector lands its answers as numbered files, ``000000000001.xml`` and so
on. Options: ``path`` (the folder), ``kind`` (``rss_feed``, ``atom_feed``,
``github_releases`` or ``pages``) and, for streams, ``progress`` (a file). A
row is an item as it was landed; adapters make releases of it
(:func:`ledgerloom.sources.registry.stream`), pages go to a parser profile.

A stream's offset is the last number up to which no file is missing, so a file
that is still on its way holds back those behind it and none is passed over.
After the sink has written a batch Spark commits its offset, and only then
``progress`` tells the collector how far it got: a run that dies in between
reads the same files again under the same batch id. Folders are opened by
``pyarrow.fs`` on driver and executors, so they must be local to all (a mount),
or of a store that it knows. A file that is not well formed is an error.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerloom.sources import feeds

KINDS = {
    "rss_feed": ("xml", feeds.ITEM),
    "atom_feed": ("xml", feeds.ENTRY),
    "github_releases": ("json", feeds.RELEASES),
    "pages": ("json", "page_id bigint, url string, html string"),
}
_ATOM = "{http://www.w3.org/2005/Atom}"
_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"


class Landed(InputPartition):
    """One file."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _said(item, tag: str) -> str | None:
    found = item.find(tag)
    return None if found is None else "".join(found.itertext()) or None


def rss_items(file) -> Iterator[tuple]:
    for _, item in ElementTree.iterparse(file):
        if item.tag == "item":
            yield tuple(_said(item, c) for c in ("title", "link", "description", "encoded", _CONTENT, "pubDate", "guid"))
            item.clear()


def atom_entries(file) -> Iterator[tuple]:
    for _, item in ElementTree.iterparse(file):
        if item.tag in ("entry", f"{_ATOM}entry"):
            space = item.tag[: -len("entry")]
            links = [(link.get("href"),) for link in item.findall(f"{space}link")] or None
            said = {c: _said(item, space + c) for c in ("title", "summary", "content", "published", "updated", "id")}
            yield said["title"], links, said["summary"], said["content"], said["published"], said["updated"], said["id"]
            item.clear()


def release_items(file) -> Iterator[tuple]:
    fields = ("id", "tag_name", "name", "body", "draft", "prerelease", "published_at", "created_at", "html_url")
    for item in json.load(file):
        assets = [(a.get("name"), a.get("size"), a.get("browser_download_url")) for a in item.get("assets") or []]
        yield (*(item.get(c) for c in fields), assets if "assets" in item else None)


def page_items(file) -> Iterator[tuple]:
    """A page a line, as JSON."""
    for line in file:
        if line.strip():
            item = json.loads(line)
            yield item.get("page_id"), item.get("url"), item.get("html")


_ITEMS = {"rss_feed": rss_items, "atom_feed": atom_entries, "github_releases": release_items, "pages": page_items}


def _numbered(path: str) -> int | None:
    found = re.search(r"(?:^|/)(\d+)\.[a-z]+$", path)
    return int(found[1]) if found else None


class _Files:
    def __init__(self, options):
        self.kind, self.folder, self.progress = options["kind"], options["path"], options.get("progress")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; known: {', '.join(sorted(KINDS))}")

    def name(self, number: int) -> str:
        return f"{self.folder.rstrip('/')}/{number:012d}.{KINDS[self.kind][0]}"

    def read(self, partition: Landed) -> Iterator[tuple]:
        store, path = fs.FileSystem.from_uri(partition.path)
        with io.BufferedReader(store.open_input_stream(path)) as file:
            yield from _ITEMS[self.kind](file)


class LandedReader(_Files, DataSourceReader):
    """All numbered files of the folder, one a task."""

    def partitions(self) -> list[Landed]:
        store, folder = fs.FileSystem.from_uri(self.folder)
        numbers = (_numbered(f.path) for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file)
        return [Landed(self.name(n)) for n in sorted(n for n in numbers if n is not None)]


class LandedStream(_Files, DataSourceStreamReader):
    """Files in the order of their numbers."""

    #: files asked for at once
    STEP = 256

    def __init__(self, options):
        super().__init__(options)
        self.taken = self.told()

    def told(self) -> int:
        """The number that the last run committed, up to which all files are there; none is 0."""
        if not self.progress:
            return 0
        store, path = fs.FileSystem.from_uri(self.progress)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(path) as file:
            return json.loads(file.read())["taken"]

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        store, _ = fs.FileSystem.from_uri(self.folder)
        while True:
            asked = [self.name(self.taken + i) for i in range(1, self.STEP + 1)]
            there = [f.type == fs.FileType.File for f in store.get_file_info([fs.FileSystem.from_uri(a)[1] for a in asked])]
            run = there.index(False) if False in there else len(there)
            self.taken += run
            if run < len(there):
                return {"taken": self.taken}

    def partitions(self, start: dict, end: dict) -> list[Landed]:
        return [Landed(self.name(n)) for n in range(start["taken"] + 1, end["taken"] + 1)]

    def commit(self, end: dict) -> None:
        if self.progress:
            store, path = fs.FileSystem.from_uri(self.progress)
            with store.open_output_stream(path) as file:
                file.write(json.dumps(end).encode())


class LandedSource(DataSource):
    """``spark.read.format("landed")`` and ``spark.readStream.format("landed")``."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return KINDS[_Files(self.options).kind][1]

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)
