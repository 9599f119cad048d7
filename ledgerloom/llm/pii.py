"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers find and check the spans.

The cues are at-signs, plus signs, digits, schemes and identifier words; one
pass of the automaton over a text finds them all. At each cue a parser that
only looks at the characters around it expands the span and checks it
(labels of a host, parts of an address, Luhn and mod-97 sums, digit counts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, source_columns, whole_row

#: Kinds in the order in which spans are listed; the first four are the contract's base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "secret", "login")
BASE = KINDS[:4]
_IDENTIFIERS = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "passport", "kontonummer", "compte", "cuenta"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api key"),
}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"[^0-9A-Za-z\n]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_IBAN = re.compile(r"[^0-9A-Za-z\n]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:number|no|nr|id))?[\x20.:#=]{1,4}([0-9]{6,17})(?![0-9])")
_SECRET = re.compile(r"[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_/+-]{16,})")
_LOGIN = re.compile(r"://([^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+)@[A-Za-z0-9]")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    cues = ahocorasick.Automaton()
    for kind, words in _IDENTIFIERS.items():
        for word in words:
            for spelled in {word, word.upper(), word.capitalize(), word.title()}:
                cues.add_word(spelled, (kind, len(spelled)))
    for sign, kind in {"@": "at", "+": "plus", "://": "scheme", **{d: "digit" for d in "0123456789"}}.items():
        cues.add_word(sign, (kind, len(sign)))
    cues.make_automaton()
    return cues


def _luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of all spans, by kind and start.

    Per kind spans do not overlap: a cue inside an earlier match of its kind
    is passed over, whether or not that match was valid.
    """
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin

    def keep(kind: str, start: int, end: int) -> None:
        found[kind].append((kind, start, end))
        free[kind] = end

    if text:
        for last, (cue, length) in _automaton().iter(text):
            at = last + 1 - length
            if cue == "digit":
                if at >= free["ip"]:
                    if m := _IP.match(text, at):
                        free["ip"] = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                            keep("ip", at, m.end())
                    else:  # no address begins in this run of digits
                        free["ip"] = _DIGITS.match(text, at).end()
                if at >= free["card"] and (m := _CARD.match(text, at)):
                    free["card"] = m.end()
                    if 13 <= m.end() - at <= 37:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and _luhn(digits):
                            keep("card", at, m.end())
            elif cue == "at":
                if m := _DOMAIN.match(text, at + 1):
                    start, least = at, free["email"]
                    while start > least and text[start - 1] in _LOCAL:
                        start -= 1
                    if start < at:
                        keep("email", start, m.end())
            elif cue == "plus":
                if (m := _PHONE.match(text, at)) and 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    keep("phone", at, m.end())
            elif cue == "scheme":
                if at >= free["login"] and (m := _LOGIN.match(text, at)):
                    keep("login", *m.span(1))
            elif at == 0 or not text[at - 1].isalnum():
                pattern = {"ssn": _SSN, "iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[cue]
                if (m := pattern.match(text, last + 1)) and m.start(1) >= free[cue] and (cue != "iban" or _mod97(m[1])):
                    keep(cue, *m.span(1))
    return [s for kind in KINDS for s in found[kind]]


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``spans``: an array of ``kind, start, end`` by kind (as in KINDS), then start.

    Whole texts are searched; null text counts as empty and has no span. Rows
    are searched one by one, so ties and repeated rows make no difference; an
    empty table gives an empty result; an input column named ``spans`` is
    replaced.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = [spans(t.as_py()) for t in texts]
            flat = [s for found in each for s in found]
            offsets = [0]
            for found in each:
                offsets.append(offsets[-1] + len(found))
            columns = [pa.array([s[i] for s in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))

    rows = docs.select(whole_row(docs).alias("src"), searched(col(text_col).cast("string")).alias("found"))
    names = [c for c in docs.columns if c.lower() != "spans"]
    return rows.select(*[c for c, name in zip(source_columns(docs), docs.columns) if name in names], F.col("found").alias("spans"))
