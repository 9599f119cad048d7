import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, ladders, text, urls, versions


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_slug_and_phrases(spark):
    rows = [("OBS Studio 32.1!",), ("  --  ",), (None,), ("A&amp;B",)]
    assert values(spark, rows, "x string", text.slugify(F.col("x"), default="unknown")) == ["obs-studio-32-1", "unknown", "unknown", "a-b"]
    assert values(spark, [("a_b--c  d",)], "x string", text.public_phrase(F.col("x"))) == ["a b c d"]
    lists = [([],), (["a"],), (["a", "b"],), (["a", "", "b", "c"],)]
    assert values(spark, lists, "x array<string>", text.prose_list(F.col("x"))) == ["", "a", "a and b", "a, b, and c"]
    assert values(spark, [(0,), (10,), (11,)], "x int", text.number_word(F.col("x"))) == ["zero", "ten", "11"]


def test_excerpt_and_html(spark):
    long = "word " * 100
    got = values(spark, [("a  b\n c",), (long,), (None,)], "x string", text.excerpt(F.col("x"), 20))
    assert got == ["a b c", "word word word...", ""]
    page = "<p>A &amp; B<br>c</p><script>x()</script><b>d</b>"
    assert values(spark, [(page,)], "x string", text.strip_tags(F.col("x"))) == ["A & B\nc\n\n d"]
    assert values(spark, [("<title> a\n b</title>",), (None,)], "x string", text.html_title(F.col("x"))) == ["a b", ""]


def test_asset_size_rounds_as_printf(spark):
    import math
    import random

    draw = random.Random(5)
    sizes = [2.5, 2560.0, 1310720.0, 3932160.0, 1310720.0 * 3, 1.15 * 2**20, 99.95 * 2**20, 99.9499999 * 2**20, 1.25 * 2**30, 2.35 * 2**30, 2.0**20 - 0.25, 123456.5, 5e12]
    sizes += [draw.randrange(1, 800) * 131072.0 for _ in range(200)] + [math.exp(draw.uniform(0, 30)) for _ in range(300)]

    def shown(x):
        k = 0
        while x >= 1024 and k < 3:
            x, k = x / 1024, k + 1
        return f"{x:.{1 if k > 1 and x < 100 else 0}f} {('B', 'KB', 'MB', 'GB')[k]}"

    assert values(spark, [(x,) for x in sizes], "x double", text.asset_size(F.col("x"))) == [shown(x) for x in sizes]


def test_asset_size(spark):
    rows = [(0,), (None,), (512,), (2048,), (5 * 1024**2,), (300 * 1024**2,), (3 * 1024**3,)]
    assert values(spark, rows, "x bigint", text.asset_size(F.col("x"))) == ["", "", "512 B", "2 KB", "5.0 MB", "300 MB", "3.0 GB"]


@pytest.mark.parametrize(
    "url,specific",
    [
        ("https://www.reddit.com/r/obs/comments/abc/title", True), ("https://www.reddit.com/r/obs", False),
        ("https://github.com/a/b/issues/12", True), ("https://github.com/a/b/issues", False),
        ("https://forum.blackmagicdesign.com/viewtopic.php?f=1&t=22", True), ("https://forum.blackmagicdesign.com/viewtopic.php?f=1", False),
        ("https://learn.microsoft.com/en-us/answers/questions/2412345/x", True), ("https://techcommunity.microsoft.com/t5/a/b/m-p/123", True),
        ("https://example.com/forum", False), ("https://example.com/thread/1", True), ("ftp://example.com/thread/1", False), (None, False),
    ],
)
def test_specific_report(spark, url, specific):
    assert values(spark, [(url,)], "x string", urls.specific_report(F.col("x"))) == [specific]


def test_urls(spark):
    assert values(spark, [(" HTTPS://A.com/X// ",)], "x string", urls.normalize_url(F.col("x"))) == ["https://a.com/x"]
    assert values(spark, [("https://A.com//X/?q=1#f",)], "x string", urls.canonical_page(F.col("x"))) == ["https://a.com/X"]


def test_dates(spark):
    rows = [("2024-05-01", "2024-05-01"), ("2024-04-30T23:59:59Z", "2024-05-01"), (None, "2024-05-01"), ("bad", "2024-05-01"), ("2024-05-01", None)]
    assert values(spark, rows, "a string, b string", dates.date_passes(F.col("a"), F.col("b"))) == [True, False, False, False, None]
    now = dt.datetime(2024, 7, 15)
    stale = dates.is_stale(dates.parse_iso(F.col("a")), F.lit(now), 14)
    assert values(spark, [("2024-07-10",), ("2024-07-01",), ("nope",)], "a string", stale) == [False, True, True]
    got = values(spark, [("Posted today",), ("2 months ago",), ("3 hours ago",), ("soon",)], "a string", dates.relative_date(F.col("a"), F.lit(now)))
    assert [(g["at"], g["precision"]) if g else None for g in got] == [
        (now, "day"), (now - dt.timedelta(days=60), "coarse"), (now - dt.timedelta(hours=3), "instant"), None,
    ]


def test_versions(spark):
    rows = [("crash in 32.1.2 now", "32.1.2"), ("crash in 32.1.2.", "32.1.2"), ("v132.1.2", "32.1.2"), ("Version 1 (B)", "(b)"), ("x", "")]
    assert values(spark, rows, "t string, v string", versions.mentions(F.col("t"), F.col("v"))) == [True, False, False, True, False]
    order = [r[0] for r in spark.createDataFrame([("1.10",), ("1.9",), ("1.9a",)], "v string").orderBy(versions.natural_key(F.col("v"))).collect()]
    assert order == ["1.9", "1.9a", "1.10"]
    got = values(spark, [("1.x.3",)], "v string", versions.int_tuple(F.col("v")))
    assert got == [[1, 0, 3]]
    names = [("DaVinci Resolve 19.1.2",), ("DaVinci Resolve Studio 20 Public Beta 3",), ("Fusion 9",), ("DaVinci Resolve 20 beta",)]
    got = values(spark, names, "v string", versions.normalize_release(F.col("v"), "DaVinci Resolve"))
    assert [tuple(g) if g else None for g in got] == [("19.1.2", "stable"), ("20-beta-3", "beta"), None, ("20-beta-1", "beta")]
    assert values(spark, [("use 1.2 or 1.2.3 or 10.2",)], "t string", versions.most_specific(F.col("t"))) == ["1.2.3"]
    assert values(spark, [("25.2",)], "v string", versions.aliases(F.col("v"), ("Premiere",))) == [["Premiere 25.2", "25.2.0", "Premiere 25.2.0"]]


def test_ladders(spark):
    assert values(spark, [(n,) for n in (0, 1, 7, 8, 24, 25, 32, 33)], "n int", buckets.confidence(F.col("n"))) == [
        "Insufficient", "Low", "Low", "Low-Medium", "Low-Medium", "Medium", "Medium", "High",
    ]
    rows = [(0, 0, 0), (9, 11, 20), (11, 0, 20), (11, 1, 20), (10, 0, 20)]
    assert values(spark, rows, "p int, n int, t int", buckets.consensus_label(F.col("p"), F.col("n"), F.col("t"))) == [
        "Insufficient data", "Negative", "Positive", "Moderate", "Moderate",
    ]
    terms = ("crash", "freeze")
    texts = [("It will freeze",), ("Announcement: a freeze",), ("Announcement of a crash",), ("fine",), (None,)]
    assert values(spark, texts, "t string", buckets.describes_issue(F.col("t"), terms)) == [True, False, True, False, False]
    assert values(spark, [(None,), ("HIGH",), ("odd",)], "s string", buckets.severity_rank(F.col("s"))) == [1, 3, 0]


def test_ladders_are_climbed_once(spark):
    """No rung of a ladder stands in the generated method of a stage, nor twice in a plan."""
    rows = spark.createDataFrame([("Magic Mask crash on Mac", "obs-studio", "scene list"), (None, "x", None)], "x string, product string, area string")
    found = rows.select(ladders.classify(F.col("x"), "blackmagic-davinci").alias("c"), ladders.public_bucket(F.col("product"), F.lit(""), F.col("area"), F.col("x")).alias("b"))
    got = found.select("c.theme", "c.platform", "c.severity", "b").collect()
    assert [tuple(r) for r in got] == [("magic mask crash", "macos", "high", "scene list workflow regressions"), ("unspecified issue", "unknown", "medium", "general workflow reports")]
    plan = found.select("c.*", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("magic mask)") == 1 + 1 and plan.count("xcomposite)") == 1
