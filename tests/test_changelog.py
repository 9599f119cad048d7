import hashlib
import json

from ledgerloom.sources import changelog, pages, registry

LIST = """<a href="/changelog/b">B</a><a href="https://other.com/changelog/x">x</a><a href="/changelog/tag/y">y</a><a href="/n/1">see /releases/ of May</a>
<a href="/changelog/b">again</a><a href="/changelog/gone">not landed</a><a href="/about">about</a>"""
ENTRY = "<html><title>T | Netlify</title><h1>Re<b>lease</b> &amp; 2</h1><article>{}</article><p>{}</p></html>"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:16]


def test_entries_of_a_changelog(spark, tmp_path):
    listings = [(1, "p", "https://s.com/changelog/", LIST), (2, "q", "https://q.com/", "<h2>Only 2024-05-06</h2>"), (3, "r", "https://r.com/", None)]
    long = "word " * 30
    details = [("https://s.com/changelog/b", ENTRY.format(long, "2024-05-03 and May 4, 2024")), ("https://s.com/n/1", "<title>Next – Netlify</title>On May 4, 2024 <i>x</i>"), ("https://s.com/about", "no")]
    for name, rows, fields in (("l", listings, ("page_id", "product_id", "url", "html")), ("d", details, ("url", "html"))):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(fields, r))) for r in rows), encoding="utf-8")
    read = lambda **o: registry.read(spark, "html_changelog", str(tmp_path / "l"), details=str(tmp_path / "d"), **o).orderBy("page_id", "nth").collect()
    got = read()
    assert [(r["title"], r["version"], r["published_at"], r["source_url"]) for r in got] == [
        ("Re lease & 2", "Re lease & 2", "2024-05-03T00:00:00Z", "https://s.com/changelog/b"), ("Next", "Next", "May 4, 2024", "https://s.com/n/1"),
    ]
    assert got[0]["body"] == long.strip() and got[1]["body"].endswith("On May 4, 2024 x")
    assert got[0]["record_id"] == "html:p:" + digest("https://s.com/changelog/b", "Re lease & 2", "2024-05-03T00:00:00Z")
    assert len(read(limit=1)) == 1 and len(read(links=1)) == 1 and len(read(body_chars=4)[0]["body"]) == 4
    got = read(snapshot=True)
    assert [(r["page_id"], r["title"], r["published_at"], r["source_type"]) for r in got[2:]] == [
        (2, "Only 2024-05-06", "2024-05-06T00:00:00Z", "html-changelog-snapshot"), (3, "Official changelog update", None, "html-changelog-snapshot"),
    ]
    assert got[2]["record_id"] == "html:q:" + digest("<h2>Only 2024-05-06</h2>")
    site = [(1, "p", "https://www.netlify.com/changelog/", '<a href="/changelog/2024/05/03/a/">a</a><a href="/changelog/tag/b">b</a><a href="https://netlify.com/changelog/2024/5/3/c">c</a>')]
    found = pages.links(spark.createDataFrame(site, changelog.LISTING), changelog.entry_link("netlify_changelog"))
    assert [r["label"] for r in found.orderBy("nth").collect()] == ["a", "c"]


def test_entities_without_semicolon(spark):
    page = "<h1>a &amp; b &amp c &ampx; &#38; &#38 &copy;</h1>"
    listing = spark.createDataFrame([(1, "p", "https://s.com/", page)], changelog.LISTING)
    title = lambda **o: changelog.entries(listing, listing.select("url", "html"), snapshot=True, **o).first()["title"]
    assert title() == "a & b & c &x; & & ©"
    assert title(loose=False) == "a & b &amp c &ampx; & &#38 ©"


def test_windows_records(spark):
    html = """<table><tr><th>Version</th><th>Servicing option</th><th>Latest revision date</th><th>Latest build</th></tr><tr><td>24H2</td><td>GA</td><td>2026-06-01</td><td>26100.8737</td></tr>
    <tr><td>23H2</td><td>Long-Term</td><td>2026-06-01</td><td>22631.1</td></tr><tr><td>25H2</td><td>GA</td><td>soon</td><td>26200.8737</td></tr></table>
    <table><tr><th>Servicing</th><th>Out</th><th>OS</th><th>Article</th></tr><tr><td>GA</td><td>x</td><td>26100.8737</td><td>KB5000001</td></tr>
    <tr><td>GA</td><td>x</td><td>26200.8737</td><td>KB5000002</td></tr><tr><td>GA</td><td>x</td><td>26200.8737</td><td>KB5000003</td></tr></table>"""
    made = spark.createDataFrame([(1, "https://w", html)], "page_id int, url string, html string")
    got = pages.windows_releases(made, "windows-11", "Windows 11").orderBy("version").collect()
    assert [(r["version"], r["kb"]) for r in got] == [("24H2", "KB5000001"), ("25H2", "")]
    assert got[0]["record_id"] == "microsoft:windows-11:24H2:" + digest("https://w", "24H2", "26100.8737")
    assert got[0]["official_summary"] == "Windows 11 24H2 latest OS build is 26100.8737 (KB5000001) (revised 2026-06-01)."
    assert got[1]["official_summary"] == "Windows 11 25H2 latest OS build is 26200.8737."
    assert got[0]["body"].startswith("Windows 11 24H2 is a current General Availability Channel servicing version. Latest OS build 26100.8737 (KB5000001). Latest revision date 2026-06-01. This is")
