"""Text columns: normal forms, slugs, excerpts, HTML stripping, sizes, lists in prose."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """No white space at either end (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def normal(c: Column) -> Column:
    """Trimmed text, blank and null alike as empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def known(c: Column) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def first_known(*columns: Column) -> Column:
    """The first that is not blank, else empty."""
    return F.coalesce(*[known(c) for c in columns], F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def slugify(c: Column, most: int | None = None, default: str = "") -> Column:
    """Lower case, everything but a-z and 0-9 as single hyphens, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&[a-z0-9#]+;", "-"), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-|-$", "")
    if most:
        slug = F.regexp_replace(F.substring(slug, 1, most), "-$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug) if default else slug


def excerpt(c: Column, width: int = 280, mark: str = "...") -> Column:
    """Collapsed text of at most ``width`` characters, cut at a space and marked."""
    text = collapse(c)
    room = width - len(mark)
    # whole words while they and the mark fit; one that is too long by itself leaves the mark alone
    head = F.regexp_extract(text, rf"(?s)^(.{{0,{room}}})(?=\s|$)", 1)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.rtrim(head), F.lit(mark)))


_ENDED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][A-Za-z0-9]*);")


def _ended(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" else html5.get(found[0][1:], found[0])


def unescape(c: Column, loose: bool = True) -> Column:
    """HTML entities as characters; Spark has no such function. Not ``loose``: only those that end with their semicolon."""
    read = html.unescape if loose else lambda t: _ENDED.sub(_ended, t)

    @F.pandas_udf("string")
    def characters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: read(t) if isinstance(t, str) and "&" in t else t)

    return characters(c)


def strip_tags(c: Column, entities: bool = True, loose: bool = True) -> Column:
    """Text of an HTML fragment: no scripts, styles or tags; breaks kept as line feeds; entities as :func:`unescape` reads them."""
    for pattern, to in (
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p\s*>", "\n\n"),
        (r"<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    c = unescape(c, loose) if entities else c
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "[ \t]+\n", "\n"))


def html_title(c: Column) -> Column:
    """Collapsed content of the first title element, else empty."""
    return collapse(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def _whole(x: Column, unit: str) -> Column:
    return F.format_string(f"%.0f {unit}", F.rint(x))


def _tenths(x: Column, unit: str) -> Column:
    """One decimal of a value from 1 to 100, rounded by its exact binary value, ties to even (Java's formats round its shortest digits, ties up)."""
    below = F.floor(x)
    # a multiple of 2^-52 below 1, so the integers here are exact
    scaled = ((x - below) * float(1 << 52)).cast("bigint") * 10
    n = below * 10 + F.shiftright(scaled, 52)
    rest, half = scaled.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    n = n + F.when((rest > half) | ((rest == half) & (n % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%d.%d {unit}", ((n - n % 10) / 10).cast("bigint"), n % 10)


def asset_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB; one decimal from MB on below 100; blank for none. Halves go to the even digit."""
    size = F.coalesce(size.cast("double"), F.lit(0.0))
    shown = F.when(size <= 0, F.lit("")).when(size < 1024, _whole(size, "B")).when(size < 1024**2, _whole(size / 1024, "KB"))
    for power, unit in ((2, "MB"), (3, "GB")):
        part = size / float(1024**power)
        text = F.when(part >= 100, _whole(part, unit)).otherwise(_tenths(part, unit))
        shown = shown.otherwise(text) if unit == "GB" else shown.when(size < 1024**3, text)
    return shown


def public_phrase(c: Column) -> Column:
    """Underscores and hyphens as spaces, collapsed."""
    return collapse(F.regexp_replace(normal(c), "[_-]+", " "))


def prose_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; blank items left out."""
    items = F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")
    n = F.size(items)
    return (
        F.when(n == 0, F.lit("")).when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.get(items, n - 1)))
    )


def number_word(n: Column) -> Column:
    """Numbers up to ten in words."""
    words = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    return F.coalesce(F.get(F.array(*map(F.lit, words)), F.when(n.between(0, 10), n).otherwise(F.lit(-1)).cast("int")), n.cast("string"))


def scrub_secrets(c: Column) -> Column:
    """Values of sensitive URL parameters as REDACTED."""
    return F.regexp_replace(c, r"(?i)([?&](?:access_token|token|api_?key|key|secret|password|sig|signature)=)[^&#\s]+", "$1REDACTED")


def normal_notes(c: Column) -> Column:
    """Release notes in a readable form: the heading of a generated list, pull requests and the changelog as links."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?im)^(#{1,6})\s+What['\u2019]s Changed\s*$", "$1 Changes")
    c = F.regexp_replace(c, r"\s+by\s+(@[A-Za-z0-9_.-]+)\s+in\s+(https://github\.com/[^\s)]+/pull/(\d+))", " by $1 ([PR #$3]($2))")
    return F.regexp_replace(c, r"(?im)^\*\*Full Changelog\*\*:\s*(https://github\.com/\S+)\s*$", "[Full changelog]($1)")


def plain_markdown(c: Column, entities: bool = False) -> Column:
    """Text of a Markdown body: no tags, headings, bullets, code marks or link targets."""
    c = normal_notes(strip_tags(F.coalesce(c, F.lit("")), entities))
    for pattern, to in ((r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        c = F.regexp_replace(c, pattern, to)
    return collapse(c)


def summarize(c: Column, most: int = 420) -> Column:
    """The plain text of notes, cut at a word and ended with a point."""
    plain = plain_markdown(c)
    head = F.substring(plain, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    short = F.concat(F.regexp_replace(cut, "[.,;:]+$", ""), F.lit("."))
    none = "Official release notes were detected, but no summary has been generated yet."
    return F.when(plain == "", F.lit(none)).when(F.length(plain) <= most, plain).otherwise(short)


def truncate(c: Column, most: int = 140) -> Column:
    """A public phrase of at most ``most`` characters before its mark."""
    phrase = public_phrase(c)
    return F.when(F.length(phrase) <= most, phrase).otherwise(F.concat(F.rtrim(F.substring(phrase, 1, most - 1)), F.lit("...")))


def short_hash(*parts: Column, size: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts in a row: an id where a source has none."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def main_body(page: Column, least: int = 300, most: int = 9000) -> Column:
    """Text of a page's article, else of its main part, if it is longer than ``least``; else empty."""
    out = F.lit("")
    for tag in ("main", "article"):
        inner = strip_tags(F.regexp_extract(F.coalesce(page, F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), entities=False)
        out = F.when(F.length(inner) > least, F.substring(inner, 1, most)).otherwise(out)
    return out


def json_strings(c: Column) -> Column:
    """All strings of a JSON text, however deep, joined by spaces in order, empty for bad JSON; built-in functions do not recurse."""

    def walk(value) -> list[str]:
        if isinstance(value, str):
            return [value]
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
        return [s for v in inner for s in walk(v)]

    def read(text: str | None):
        try:
            return json.loads(text) if isinstance(text, str) else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def strings(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(walk(read(t))))

    return strings(c)
