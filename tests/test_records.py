import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import gates, records


def day(month, n, hour=0):
    return dt.datetime(2026, month, n, hour)


def test_resolve_versions(spark):
    releases = spark.createDataFrame([("p", "26.1", "2026-01-01"), ("p", "26.2.0", "2026-03-01"), ("p", "26.3 beta", "2026-03-10"), ("p", "26.3.0", "2026-06-01")], "product_id string, update_version string, update_published_at string")
    cases = {
        "full": ("crash in 26.2.0", day(4, 1), "day", ("26.2.0", "exact_version", None)),
        "two": ("26.2.0 and 26.1.9", day(4, 1), "day", (None, None, "conflicting_exact_version_mentions")),
        "other": ("crash in 26.3.0", day(4, 1), "day", (None, None, "conflicting_exact_version_for_active_release_window")),
        "undated full": ("crash in 26.2.0", None, None, ("26.2.0", "exact_version", None)),
        "short": ("crash in 26.2", day(4, 1), "day", ("26.2.0", "truncated_version_in_release_window", None)),
        "short undated": ("crash in 26.2", None, None, (None, None, "missing_resolvable_source_date_for_inferred_match")),
        "short early": ("crash in 26.2", dt.datetime(2025, 1, 1), "day", (None, None, "source_date_outside_release_windows")),
        "short other": ("crash in 26.1", day(4, 1), "day", (None, None, "truncated_version_outside_active_release_window")),
        "coarse": ("crash in 26.2", day(3, 1, 5), "coarse", (None, None, "source_date_too_coarse_near_release_boundary")),
        "instant": ("crash in 26.2", day(3, 1, 5), "instant", ("26.2.0", "truncated_version_in_release_window", None)),
        "current": ("the latest version crashes", day(7, 1), "day", ("26.3.0", "release_window_inferred", None)),
        "beta": ("latest release beta crashes", day(7, 1), "day", ("26.3 beta", "release_window_inferred", None)),
        "none": ("it crashes", day(7, 1), "day", (None, None, "missing_exact_patch_version_match")),
    }
    reports = spark.createDataFrame([(k, "p", *v[:3]) for k, v in cases.items()], "report_id string, product_id string, report_text string, at timestamp, precision string")
    got = {r["report_id"]: (r["update_version"], r["match_basis"], r["rejection_reason"]) for r in records.resolve_versions(reports, releases).collect()}
    assert got == {k: v[3] for k, v in cases.items()}


def test_refresh_keeps_and_replaces(spark):
    schema = "product_id string, update_version string, url string, body string, issues int, source_last_checked string"
    stored = spark.createDataFrame([("p", "1", "", "old", 1, "t0"), ("p", "2", "u", "same", 2, "t0"), ("p", "3", "u", "b", 3, "t0")], schema)
    stored = stored.withColumn("official_source_attempts", F.sequence(F.lit(1), F.lit(5)).cast("array<string>"))
    incoming = spark.createDataFrame([("p", "1", "n", "new", None, "t1"), ("p", "1", "x", "x", 9, "t0"), ("p", "2", "z", " same ", None, "t1"), ("p", "4", "u", "b", 0, "t1")], schema)
    got = {r["update_version"]: r for r in records.refresh_records(stored, incoming, ["url"], ["body"], ["issues"]).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"1": "refreshed", "2": "freshness-updated", "3": "unchanged", "4": "created"}
    assert (got["1"]["url"], got["1"]["body"], got["1"]["issues"]) == ("n", "new", 1) and got["1"]["official_source_attempts"] == ["2", "3", "4", "5", "t1"]
    assert got["2"]["url"] == "u" and got["3"]["official_source_attempts"] == ["1", "2", "3", "4", "5"]


def test_lenient_inclusion_reads_the_text(spark):
    rows = spark.createDataFrame(
        [("a", None, None, "crash in 26.2", "negative"), ("b", None, None, "crash", "negative"), ("c", True, False, "", "negative"), ("d", True, None, "", "odd")],
        "id string, patch_version_matched boolean, counted boolean, report_title string, sentiment string",
    ).withColumns({"update_version": F.lit("26.2"), "parent_title": F.lit(None).cast("string"), "report_text_excerpt": F.lit(None).cast("string")})
    got = gates.gated(rows, records.lenient_inclusion())
    assert {r["id"]: r["exclusion_reason"] for r in got.collect()} == {"a": None, "b": "not_patch_specific", "c": "counted_false", "d": "invalid_sentiment"}


def test_listing_cards_use_up_lines(spark):
    text = "\n".join(["Bug one", "Bug two", "x", "x", "x", "x", "x", "Bug three", "", "Bug one"] + ["y"] * 7 + ["bug ONE", "Bug four"])
    page = spark.createDataFrame([(1, text), (2, None)], "page_id int, text string")
    got = records.listing_cards(page, lambda line: line.lower().startswith("bug")).orderBy("line_no").collect()
    assert [r["title"] for r in got] == ["Bug one", "Bug three", "Bug four"]
