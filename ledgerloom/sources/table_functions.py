"""Parsers of landed pages as table functions of a session: ``SELECT * FROM known_issues(TABLE(pages))``.

Each takes a table with a column ``html`` (for links ``url`` too) and gives the
rows that its pages hold. The table's other columns go through unchanged, so a
caller keeps its own keys; those named like a parsed column are replaced. Null
pages hold nothing. The rows are those of the functions of the same name over
DataFrames; pages are parsed one by one in tasks, in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Spark's patterns know ASCII letters and spaces only
_FLAGS = re.I | re.S | re.A
_TABLE, _ROW, _CELL = (re.compile(p, _FLAGS) for p in (r"<table\b[^>]*>.*?</table>", r"<tr\b[^>]*>.*?</tr>", r"<t[hd]\b[^>]*>(.*?)</t[hd]>"))
_ANCHOR = re.compile(r"""<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", _FLAGS)
_UNSEEN = re.compile(r"<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", _FLAGS)


_SPACE = re.compile(r"\s+", re.A)
_UNEVEN = re.compile(r"[^\S ]|  ", re.A)
_TAG = re.compile(r"<[^>]+>")


def plain(fragment: str) -> str:
    """Collapsed text of a fragment, entities as they are."""
    if "<" in fragment:
        fragment = _TAG.sub(" ", _UNSEEN.sub(" ", fragment))
    return (_SPACE.sub(" ", fragment) if _UNEVEN.search(fragment) else fragment).strip(" ")


def tables(html: str) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """Number, header in lower case and rows of each table that has a row."""
    for number, table in enumerate(_TABLE.findall(html)):
        rows = [[plain(c) for c in _CELL.findall(row)] for row in _ROW.findall(table)]
        if rows:
            yield number, [c.lower() for c in rows[0]], rows[1:]


def absolute(base: str, href: str) -> str:
    """An href seen from a page: absolute, host-relative, or relative to the page's folder."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", href):
        return href
    if href.startswith("//"):
        return (m[0] if (m := re.match("[A-Za-z]+:", base)) else "") + href
    if href.startswith("/"):
        return (m[0] if (m := re.match("[A-Za-z]+://[^/?#]*", base)) else "") + href
    return re.sub("(?<=[^:/])/[^/]*$", "", re.sub("[?#].*$", "", base)) + "/" + href


def _first(pattern: str, said: str) -> str:
    found = re.search(pattern, said, re.I | re.A)
    return found[1] if found else ""


_INT, _TEXT, _TEXTS = IntegerType(), StringType(), ArrayType(StringType())


def _schema(**columns: DataType) -> StructType:
    made = StructType()
    for name, kind in columns.items():
        made.add(name, kind)
    return made


class _Pages:
    """What all functions share: the columns that go through, and one call of ``rows`` a page."""

    parsed: StructType
    through: list[str] | None = None

    @classmethod
    def carried(cls, columns: list[str]) -> list[str]:
        taken = {"html", *(f.name.lower() for f in cls.parsed)}
        return [c for c in columns if c.lower() not in taken]

    @classmethod
    def result(cls, pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or "html" not in pages.dataType.names:
            raise ValueError("the first argument is a table with a column html")
        keep = [pages.dataType[c] for c in cls.carried(pages.dataType.names)]
        return AnalyzeResult(StructType([*keep, *cls.parsed]))

    def opened(self, page, *options) -> Iterator[tuple]:
        row = page.asDict()
        if self.through is None:  # one object reads the pages of one table
            self.through = self.carried(list(row))
        keep = tuple(row[c] for c in self.through)
        for found in self.rows(row, *options) if row["html"] is not None else ():
            yield keep + found


class PageTables(_Pages):
    """``table_no, row_no, header, cells`` of all rows under a table's first one."""

    parsed = _schema(table_no=_INT, row_no=_INT, header=_TEXTS, cells=_TEXTS)

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return PageTables.result(pages)

    def rows(self, page: dict) -> Iterator[tuple]:
        for number, header, rows in tables(page["html"]):
            yield from ((number, nth, header, cells) for nth, cells in enumerate(rows, 1))

    def eval(self, page):
        yield from self.opened(page)


class PageLinks(_Pages):
    """``nth, link, label`` of the distinct links to other pages whose link or label matches a pattern."""

    parsed = _schema(nth=_INT, link=_TEXT, label=_TEXT)

    @staticmethod
    def analyze(pages: AnalyzeArgument, pattern: AnalyzeArgument | None = None) -> AnalyzeResult:
        return PageLinks.result(pages)

    def rows(self, page: dict, pattern: str) -> Iterator[tuple]:
        here, seen = page.get("url"), set()
        for href, inner in _ANCHOR.findall(page["html"]) if here is not None else ():
            if href.startswith(("#", "mailto:")):
                continue
            link, label = absolute(here, href), plain(inner)
            if link in seen or link.rstrip("/") == here.rstrip("/") or not re.search(pattern, f"{link} {label}", re.I | re.A):
                continue
            seen.add(link)
            yield len(seen), link, label

    def eval(self, page, pattern: str = ""):
        yield from self.opened(page, pattern)


class KnownIssues(_Pages):
    """The known issues of a status page: rows of its first table with summary and status that has any."""

    parsed = _schema(
        row_no=_INT, summary=_TEXT, status_raw=_TEXT, state=_TEXT, originating_build=_TEXT, originating_kb=_TEXT,
        resolving_kb=_TEXT, last_updated=_TEXT, safeguard_id=_TEXT,
    )

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return KnownIssues.result(pages)

    def rows(self, page: dict) -> Iterator[tuple]:
        for _, header, rows in tables(page["html"]):
            at = {name: next((i for i, h in enumerate(header) if name in h), None) for name in ("summary", "status", "originating", "last updated")}
            if at["summary"] is None or at["status"] is None:
                continue
            found = [issue for nth, cells in enumerate(rows, 1) if (issue := self.issue(nth, at, cells))]
            if found:
                yield from found
                return

    @staticmethod
    def issue(nth: int, at: dict[str, int | None], cells: list[str]) -> tuple | None:
        said = {name: cells[i] if i is not None and i < len(cells) else "" for name, i in at.items()}
        summary, status, origin = said["summary"], said["status"], said["originating"]
        if not summary or not status:
            return None
        kb, resolved = r"\b(KB\s?\d{6,7})\b", status.lower().startswith("resolved")
        return (
            nth, summary, status, "resolved" if resolved else "active", _first(r"\b(\d{4,5}\.\d{1,5})\b", origin), _first(kb, origin),
            _first(kb, status) if resolved else "", said["last updated"], _first(r"safeguard\s+id:?\s*(\d+)", f"{summary} {status}"),
        )

    def eval(self, page):
        yield from self.opened(page)


#: Table functions by the name under which a session knows them.
FUNCTIONS = {"page_tables": PageTables, "page_links": PageLinks, "known_issues": KnownIssues}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
