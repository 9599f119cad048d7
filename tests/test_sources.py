import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sinks
from ledgerloom.sources import captures, documents, feeds, pages, registry

RSS = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><title>v1</title><link>https://a/1</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate><guid>g1</guid></item>
<item><link>https://a/2</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><entry><title>e1</title><link href="https://a/e"/><summary>s</summary><updated>2024-05-02T00:00:00Z</updated><id>i1</id></entry></feed>"""


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_front_matter(spark, tmp_path):
    write(tmp_path / "a.md", "---\nproduct_id: p\nupdate_version: 26.2\nupdate_entry: true\nnote: 'x -----'\ntags: [a, b]\n---\nBody\n---\nmore")
    write(tmp_path / "b.md", "---\nproduct_id: p\nnever closed")
    write(tmp_path / "c.md", "---\r\nproduct_id: q\r\nupdate_version: 2607\r\nupdate_entry: true\r\nupdate_status: archived\r\n---\r\nB")
    write(tmp_path / "d.md", "plain")
    docs = documents.read_documents(spark, str(tmp_path))
    got = {r["path"].rsplit("/")[-1]: r for r in docs.collect()}
    assert got["a.md"]["data"]["update_version"] == "26.2" and got["a.md"]["body"] == "Body\n---\nmore"
    assert json.loads(got["a.md"]["data"]["tags"]) == ["a", "b"]
    assert got["b.md"]["data"] == {} and got["b.md"]["body"].startswith("---")
    assert got["c.md"]["data"]["update_version"] == "2607" and got["d.md"]["data"] == {}
    assert [r["product_id"] for r in documents.records(docs).collect()] == ["p"]
    assert documents.records(docs, archived=True).count() == 2
    back = sinks.documents(documents.records(docs).withColumn("body", F.lit("x")), ["product_id", "update_version"]).first()["text"]
    assert back == '---\nproduct_id: "p"\nupdate_version: "26.2"\n---\nx'


def test_yaml_lists(spark, tmp_path):
    a = write(tmp_path / "a.yml", "evidence:\n- {id: '1', counted: false}\n- 3\n")
    b = write(tmp_path / "b.yml", "- {id: '2', counted: null}\n")
    c = write(tmp_path / "c.yml", "just text")
    assert [r["id"] for r in documents.read_yaml_list(spark, a, "evidence", "id string").collect()] == ["1"]
    assert [r["id"] for r in documents.read_yaml_list(spark, b, "evidence", "id string").collect()] == ["2"]
    assert documents.read_yaml_list(spark, c, "evidence", "id string").count() == 0
    with pytest.raises(Exception, match="expected a list"):
        documents.read_yaml_list(spark, c, "evidence", "id string", strict=True).count()


def test_feeds(spark, tmp_path):
    got = registry.read(spark, "rss_feed", write(tmp_path / "f.xml", RSS), official_url="https://o").collect()
    assert [(r["record_id"], r["title"], r["body"]) for r in got] == [("g1", "v1", "x  y".replace("  ", " ")), ("https://a/2", "Untitled update", "")]
    assert got[0]["published_at"].isoformat() == "2024-05-01T10:00:00" and got[1]["published_at"] is None
    got = registry.read(spark, "atom_feed", write(tmp_path / "a.xml", ATOM)).first()
    assert (got["record_id"], got["url"], got["body"]) == ("i1", "https://a/e", "s")
    assert registry.read(spark, "manual_watch", "").count() == 0
    with pytest.raises(ValueError, match="unknown adapter"):
        registry.read(spark, "nope", "")
    assert registry.should_run(False, "x", "p", "c", source="p") and not registry.should_run(True, "manual_watch", "p", "c", everything=True)


def test_releases(spark, tmp_path):
    items = [
        {"id": 1, "tag_name": "v32.1", "name": "R", "body": "notes\n\n## Checksums\nabc", "published_at": "2024-05-01T00:00:00Z",
         "assets": [{"name": "mac.dmg", "size": 5}, {"name": "win.exe", "size": 5 * 1024**2}]},
        {"id": 2, "tag_name": "v33", "draft": True}, {"id": 3, "tag_name": "v34", "prerelease": True},
    ]
    path = write(tmp_path / "r.json", json.dumps(items))
    got = feeds.releases(spark, path, (".exe",)).collect()
    assert [(r["version"], r["body"], r["checksums"], r["asset_name"], r["file_size"]) for r in got] == [("32.1", "notes", "## Checksums\nabc", "win.exe", "5.0 MB")]
    assert feeds.releases(spark, path, prereleases=True).count() == 2
    family = ["fam"]
    items = {"downloads": [
        {"name": "Tool Pro 19.1", "numericDate": 2, "relatedFamilies": family}, {"name": "Tool Pro 19.1", "numericDate": 1, "relatedFamilies": family},
        {"name": "Tool Pro 20 Public Beta 1", "numericDate": 3, "relatedFamilies": family}, {"name": "Other 1", "numericDate": 9, "relatedFamilies": family},
        {"name": "Tool Pro 18", "numericDate": 9, "relatedFamilies": ["x"]},
    ]}
    got = feeds.downloads(spark, write(tmp_path / "d.json", json.dumps(items)), "fam", "Tool Pro").collect()
    assert [(r["version"], r["published_at"].timestamp()) for r in got] == [("19.1", 0.002)]


def test_pages(spark):
    html = """<a href="/changelog/1">One</a><a href='#x'>n</a><a href="https://o.com/changelog/2">Two</a><a href="/changelog/1">again</a>
    <h2>Continuous Track</h2><table><tr><td>24.001 released May 3, 2024</td></tr></table><h2>Unknown Track</h2><li>23.9 June 1, 2023</li>
    <table><tr><th>Version</th><th>Servicing option</th><th>Latest revision date</th><th>Latest build</th></tr>
    <tr><td>24H2</td><td>GA</td><td>2024-06-01</td><td>26100.1</td></tr><tr><td>23H2</td><td>LTSC</td><td>2024-06-01</td><td>22631.1</td></tr></table>
    <table><tr><th>Build</th><th>KB article</th></tr><tr><td>26100.1</td><td>KB555</td></tr></table>"""
    df = spark.createDataFrame([(1, "https://s.com/list/", html)], "page_id int, url string, html string")
    got = pages.links(df, pages.changelog_link()).orderBy("nth").collect()
    assert [(r["link"], r["label"]) for r in got] == [("https://s.com/changelog/1", "One"), ("https://o.com/changelog/2", "Two")]
    got = pages.carried_releases(df, r"(Continuous|Classic) Track", r"(?i)\btrack\b", r"(\d+\.\d+)\s", pages.month_date(F.col("text"))).collect()
    assert [(r["track"], r["version"], str(r["published_at"])) for r in got] == [("Continuous", "24.001", "2024-05-03")]
    got = pages.current_versions(df).collect()
    assert [(r["version"], r["build"], str(r["published_at"]), r["kb"]) for r in got] == [("24H2", "26100.1", "2024-06-01", "KB555")]


def test_captures(spark, tmp_path):
    row = {"source_url": "https://A/1/", "source_name": "s", "captured_at": "t", "capture_method": "m", "capture_status": "error"}
    path = write(tmp_path / "c.jsonl", json.dumps(row) + "\n\n" + json.dumps({**row, "error_reason": "r"}) + "\n")
    rows = captures.read(spark, path)
    assert sorted(map(tuple, (r["problems"] for r in captures.problems(rows).collect()))) == [(), ("error without reason",)]
    assert captures.read(spark, path, 1).count() == 1
    assert [r["url"] for r in captures.known_urls(spark, str(tmp_path)).collect()] == ["https://a/1"]
    with pytest.raises(Exception):
        captures.read(spark, write(tmp_path / "bad.jsonl", "{broken\n")).collect()
