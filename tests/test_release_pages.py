import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import landed, release_pages


def page(spark, html, url="https://s.com/p"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_release_notes_own_their_section(spark):
    html = "<h2>Premiere 26.2 (May 2026 release)</h2><p>Fixes</p><h3>Sub</h3><p>more</p><h2>26.1 beta</h2><p>x</p><h2>Premiere 26.0.1</h2><p>On March 3, 2026 fixed</p><h2>About</h2>"
    got = release_pages.release_notes(page(spark, html)).orderBy("nth").collect()
    assert [(r["version"], str(r["published_at"])) for r in got] == [("26.2", "2026-05-01"), ("26.0.1", "2026-03-03")]
    assert got[0]["body"] == "Premiere 26.2 (May 2026 release) Fixes Sub more" and got[0]["record_id"].startswith("html:26.2:") and len(got[0]["record_id"].split(":")[2]) == 16


def test_headings_establish_version_and_date(spark):
    heads = [
        "Photoshop 26.5 (May 2025 release)", "Photoshop desktop 26.4.1 - March 3, 2025", "Photoshop on the web 26.3 (April 2025)", "Photoshop 26.3 beta (April 2025)", "InCopy 26.0 (May 2025)",
        "Photoshop 26.2 and 26.1 (May 2025)", "Photoshop 26.1", "Photoshop 26.0 (May 2025), supersedes July 2, 2024", "Photoshop 25.9 February 30, 2024", "Photoshop 26.5 (June 2025)",
    ]
    got = release_pages.headed_releases(page(spark, "".join(f"<h3>{h}</h3><p>January 1, 2020</p>" for h in heads)), limit=None).orderBy("nth").collect()
    assert [(r["version"], str(r["published_at"]), r["precision"]) for r in got] == [("26.5", "2025-05-01", "month"), ("26.4.1", "2025-03-03", "day")]


STATUS = """<table><tr><th>Help</th><th>safeguard</th></tr><tr><td>a</td><td>b</td></tr></table>
<table><tr><th>Summary</th><th>Originating update</th><th>Status</th><th>Last updated</th></tr>
<tr><td>Printer fails safeguard ID: 555</td><td>OS Build 26100.1 KB5000001</td><td>Confirmed</td><td>2026-01-02</td></tr>
<tr><td>Boot slow</td><td>N/A</td><td>Resolved KB5000002</td><td></td></tr><tr><td></td><td></td><td>x</td><td></td></tr></table>
<table><tr><th>Summary</th><th>Status</th></tr><tr><td>other</td><td>Confirmed</td></tr></table>"""


def test_known_issues_and_their_roll_up(spark):
    issues = release_pages.known_issues(page(spark, STATUS))
    rows = issues.orderBy("row_no").collect()
    assert [(r["state"], r["originating_build"], r["originating_kb"], r["resolving_kb"], r["safeguard_id"]) for r in rows] == [("active", "26100.1", "KB5000001", "", "555"), ("resolved", "", "", "KB5000002", "")]
    records = spark.createDataFrame([(1, "24H2", "base"), (2, "23H2", "alone")], "page_id int, version string, body string")
    got = {r["version"]: r for r in release_pages.with_known_issues(records, issues, most=1).collect()}
    assert got["23H2"]["body"] == "alone" and got["23H2"]["active"] is None
    assert (got["24H2"]["active"], got["24H2"]["resolved"], got["24H2"]["safeguards"], got["24H2"]["known_issues_present"]) == (1, 1, 1, True)
    assert got["24H2"]["body"].split("\n")[3:] == [
        "- Active: Printer fails safeguard ID: 555 — status Confirmed; originating OS Build 26100.1 KB5000001; last updated 2026-01-02; safeguard ID 555.", "- …and 1 more known issue(s) on the official status page.",
    ]
    assert release_pages.known_issues(page(spark, "<table><tr><th>Status</th></tr><tr><td>x</td></tr></table>")).count() == 0


def test_update_history(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<table>" + row("Current Channel", "2606", "20130.20100", "July 14, 2026") + row("Current Channel (Preview)", "2607", "20200.20000", "July 15, 2026") + row("Current Channel", "2605", "20026.20076", "soon")
    html += row("Current Channel", "2606", "20130.20999", "July 1, 2026") + row("Current Channel", "2604", "x", "y") + row("Current Channel", "2603") + "</table>"
    got = release_pages.parse(page(spark, html), "generic").orderBy("nth").collect()
    assert [(r["version"], r["build"], r["published_at"]) for r in got] == [("2606", "20130.20100", dt.date(2026, 7, 14)), ("2605", "20026.20076", None)]


def test_app_notes(spark):
    html = """<h2>Version 2606: July 14</h2><p>Build 20130.20100</p><ul><li>PowerPoint: fixed a crash</li><li>Word only</li></ul>
    <h2>Version 2512: January 6</h2><p>Build 19530.20100</p><li>An issue in all apps is fixed</li><h2>Version 2605</h2><p>Build 1111.2222</p><li>PowerPoint</li>
    <h2>Version 2604: May 5</h2><li>PowerPoint without build</li><h2>Version 2603: April 2</h2><p>Build 1000.2000</p><li>Excel</li>"""
    got = release_pages.parse(page(spark, html), "microsoft_365_powerpoint_release_notes").orderBy("nth").collect()
    assert [(r["version"], r["build"], str(r["published_at"]), list(r["entries"]), r["suite_wide"]) for r in got] == [
        ("2606", "20130.20100", "2026-07-14", ["PowerPoint: fixed a crash"], False), ("2512", "19530.20100", "2026-01-06", ["An issue in all apps is fixed"], True),
    ]


def test_version_history_state_machine(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    table = lambda *r: "<table>" + "".join(r) + "</table>"
    html = "<h2>Public cloud</h2><h3>New Teams app version</h3><h4>Windows</h4>" + table(
        row("2026", "July 8", "26183.203.4100.5555"), row("June 30", "26170.100.200.300"), row("June 31", "26169.100.200.300"), row("June 2", "26400.1.1.1"), row("May 5", "26100.1.2.3", "Insiders"),
        row("May 4", "26099.1.2.3"), row("May 6", "26099.1.2.3"),
    )
    html += table(row("2026", "April 1", "26080.1.1.1")) + "<h4>Mac</h4>" + table(row("2026", "April 1", "26081.1.1.1")) + "<h4>Windows</h4><h5>Dev ring</h5>" + table(row("2026", "April 1", "26082.1.1.1"))
    html += "<h2>Government</h2><h3>New Teams app version</h3><h4>Windows</h4>" + table(row("2026", "April 1", "26083.1.1.1"))
    got = release_pages.parse(page(spark, html), "microsoft_teams_version_history").orderBy("nth").collect()
    assert [(r["version"], str(r["published_at"])) for r in got] == [("26183.203.4100.5555", "2026-07-08"), ("26170.100.200.300", "2026-06-30")]
    with pytest.raises(ValueError):
        release_pages.parse(page(spark, html), "none")


def test_configured_version_patterns(spark):
    df = spark.createDataFrame([("Wave Link (x) 2.1.0 notes",), ("none",)], "t string").select(release_pages.pattern_version(F.col("t"), r"(Wave Link)\s\((?:x)\)\s(?P<version>\d+\.\d+\.\d+)").alias("v"))
    assert [r["v"] for r in df.collect()] == ["2.1.0", None]


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_posts_of_search_listing_and_feed(spark, tmp_path):
    post = lambda n, text, at=1767225600.0: {"data": {"title": f"T{n}", "selftext": text, "permalink": f"/r/s/comments/{n}/x/", "url": "u", "created_utc": at, "subreddit": "s"}}
    search = landed.listing(spark, write(tmp_path / "a.json", {"data": {"children": [post(1, "one"), post(2, "old", 0.0)]}}))
    listed = landed.listing(spark, write(tmp_path / "b.json", {"data": {"children": [post(1, "again 32.1"), post(3, "about 32.1"), post(4, "nothing")]}}))
    rss = write(tmp_path / "c.xml", "<rss><channel><item><title>F 32.1</title><link>https://www.reddit.com/r/s/comments/9/x</link><pubDate>Thu, 01 Jan 2026 10:00:00 GMT</pubDate></item></channel></rss>")
    fed = landed.feed(spark, rss, "reddit_community_report", "r/s")
    got = landed.posts(search, listed, fed, [" 32.1 "], "2025-12-01").orderBy("source_url").collect()
    assert [(r["report_title"], r["report_text"], r["source_date"]) for r in got] == [
        ("T1", "T1 one", "2026-01-01T00:00:00Z"), ("T3", "T3 about 32.1", "2026-01-01T00:00:00Z"), ("F 32.1", "F 32.1", "2026-01-01T10:00:00Z"),
    ]
    both = landed.answers({"KB1": fed, " kb1": listed, "26100.1": search.unionByName(fed)}).orderBy("source_url").collect()
    assert [(r["report_title"], r["matched_query"]) for r in both] == [("T1", "26100.1"), ("T2", "26100.1"), ("F 32.1", "KB1")]


def test_threads_topics_and_snapshots(spark, tmp_path):
    index = page(spark, '<a href="/t/2?x=1">b</a><a href="/t/1">a</a><a href="https://s.com/t/2#p">again</a><a href="/about">c</a>', "https://s.com/forum/")
    links = landed.thread_links(index, F.col("link").rlike(r"/t/\d+$"))
    assert [r["link"] for r in links.collect()] == ["https://s.com/t/2", "https://s.com/t/1"]
    pages = spark.createDataFrame([("https://s.com/t/1", "<title>A crash</title><p>It crashed on March 3, 2026</p>"), ("https://s.com/t/2", "<p>solve the CAPTCHA</p>")], "url string, html string")
    assert [(r["report_title"], r["source_date"]) for r in landed.threads(pages, "forum", "Forum").collect()] == [("A crash", "2026-03-03")]
    ids = spark.createDataFrame([("7", 2), ("7", 0), ("x", 1), ("8", 3), ("9", 4)], "id string, nth int")
    topics = spark.createDataFrame([("7", "u7", "t", "b", "2026-05-01"), ("8", "u8", "t", "b", "2026-01-01"), ("9", "u9", "t", "b", None)], "id string, url string, title string, body string, created_at string")
    assert sorted(r["source_url"] for r in landed.hydrated(ids, topics, F.lit("2026-04-01")).collect()) == ["u7", "u9"]
    assert [r["source_url"] for r in landed.hydrated(ids, topics, F.lit("2026-04-01"), most=1).collect()] == ["u7"]
    found = landed.search_links(spark, write(tmp_path / "s.json", {"web": {"results": [{"url": "https://a/1"}, {"url": "https://a/1"}, {"url": ""}]}}))
    assert [r["link"] for r in found.collect()] == ["https://a/1"]
    cdx = write(tmp_path / "cdx.json", [["urlkey", "timestamp", "original"], ["k", "20260102030405", "https://a/1"], ["k", "20250102030405", "https://a/1"]])
    assert [(r["snapshot_url"], r["stamp"]) for r in landed.snapshots(spark, cdx, "https://archive/web/").collect()] == [("https://archive/web/20260102030405/https://a/1", "20260102030405")]


def test_seeds_are_judged(spark):
    seeds = spark.createDataFrame(
        [("https://a/1", "20.1", "", "issue_report_candidate", True, "2026-05-02"), ("https://a/2", "21", "future", "issue_report_candidate", False, "2026-05-02"), ("https://A/3/", "20.1", "", "release_discussion", True, "2026-05-02"), ("https://a/4", "20.1", "", "other", False, "2026-05-02")],
        "source_url string, version_raw string, target_hint string, category string, verified boolean, source_published_at string",
    )
    fetched = spark.createDataFrame([("https://a/1", True, True), ("https://a/4", False, True)], "source_url string, body_accessed boolean, issue_report boolean")
    records = spark.createDataFrame([("20.1", "2026-05-01")], "update_version string, update_published_at string")
    got = {r["source_url"]: (r["decision"], r["blocker"], r["confidence"]) for r in landed.seeded(seeds, fetched, records, spark.createDataFrame([("https://a/3",)], "source_url string")).collect()}
    assert got == {
        "https://a/1": ("promote_now", None, "high"), "https://a/2": ("future_update_not_current_record", "future_update_not_current_record", "low"),
        "https://A/3/": ("duplicate_existing_evidence", "duplicate_existing_evidence", "high"), "https://a/4": ("needs_user_verification", "needs_user_verification", "low"),
    }


def test_sweep_goes_on_where_it_stopped(spark):
    links = spark.createDataFrame([(f"l{i}", i) for i in range(5)], "link string, nth int")
    ledger, order = spark.createDataFrame([], "link string, nth bigint"), []
    for run in range(4):
        took = landed.sweep(links, ledger, budget=2)
        order.append([r["link"] for r in took.orderBy("nth").collect()])
        deferred = spark.createDataFrame([("l1",)] if run == 0 else [], "link string")
        failed = landed.swept(ledger, took, deferred, ok=False)
        assert failed.count() == ledger.count()
        ledger = spark.createDataFrame([tuple(r) for r in landed.swept(ledger, took, deferred, ok=True).collect()], "link string, nth bigint")
    assert order == [["l0", "l1"], ["l1", "l2"], ["l3", "l4"], ["l0", "l1"]]
    assert [r["link"] for r in ledger.orderBy("nth").collect()] == ["l0", "l1"]


def test_state_sources_and_method_health(spark, tmp_path):
    good = write(tmp_path / "state.json", {"sources": {"obs": {"seen": ["1"], "consecutive_failures": 2}, "x": {}}})
    assert sorted((r["source"], list(r["seen"]), r["consecutive_failures"]) for r in landed.read_state(spark, good).collect()) == [("obs", ["1"], 2), ("x", [], 0)]
    assert landed.read_state(spark, write(tmp_path / "bad.json", "{nope")).count() == 0
    config = write(tmp_path / "sources.yml", "sources:\n- product_id: a\n  company_id: c\n  enabled: true\n  extra: 1\n  ingestion: {adapter: rss_feed, limit: '5'}\n- text\n- product_id: b\n  company_id: d\n  ingestion: {adapter: manual_watch}\n")
    sources = landed.read_sources(spark, config)
    assert sorted((r["product_id"], r["enabled"], r["adapter"], r["limit"]) for r in sources.collect()) == [("a", True, "rss_feed", 5), ("b", None, "manual_watch", 2)]
    names = lambda **k: sorted(r["product_id"] for r in landed.selected(sources, **k).collect())
    assert (names(), names(everything=True), names(names=["d"]), names(names=["c"])) == (["a"], ["a"], [], ["a"])
    rows = landed.read_method_health(spark, write(tmp_path / "emh.yml", "methods:\n- {product_id: a, status: Success, candidates_found: 3}\n- {product_id: b, status: odd, accepted_reports: x}\n"))
    assert sorted((r["product_id"], r["status"], r["candidates_found"], r["accepted_reports"], r["notes"]) for r in rows.collect()) == [("a", "success", 3, 0, ""), ("b", "broken", 0, 0, "")]
