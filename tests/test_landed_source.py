import json

import pytest
from pyspark.sql import functions as F
from test_sources import ATOM, RSS

from ledgerloom.sources import feeds, registry, release_pages

MORE = RSS.replace("v1", "v3").replace("g1", "g3").replace("https://a/2", "https://a/4")
SPACED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="urn:m"><entry><m:title>no</m:title><title>e2</title><link href="https://a/x"/><link href="https://a/y"/>
<content type="html">&lt;p&gt;c&lt;/p&gt;</content><published>2024-05-03T01:02:03Z</published><id>i2</id></entry></feed>"""


def land(folder, number, said, kind="xml"):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:012d}.{kind}").write_text(said, encoding="utf-8")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_items_are_those_of_the_readers(spark, tmp_path):
    land(tmp_path / "r", 1, RSS), land(tmp_path / "r", 2, MORE)
    got = registry.landed(spark, "rss_feed", str(tmp_path / "r"))
    assert rows(feeds.rss_releases(got, "https://o")) == rows(feeds.rss(spark, str(tmp_path / "r"), "https://o")) and got.count() == 4
    land(tmp_path / "a", 1, ATOM), land(tmp_path / "a", 2, SPACED)
    assert rows(feeds.atom_releases(registry.landed(spark, "atom_feed", str(tmp_path / "a")))) == rows(feeds.atom(spark, str(tmp_path / "a")))
    items = [{"id": 1, "tag_name": "v32.1", "body": "n\n## Checksums\nabc", "assets": [{"name": "w.exe", "size": 5}]}, {"tag_name": "v33", "draft": True}, {"tag_name": "v34"}]
    land(tmp_path / "l", 1, json.dumps(items), "json")
    assert rows(feeds.listed_releases(registry.landed(spark, "github_releases", str(tmp_path / "l")))) == rows(feeds.releases(spark, str(tmp_path / "l")))
    html = "<h2>Premiere 26.2 (May 2026 release)</h2><p>Fixes</p>"
    land(tmp_path / "p", 7, json.dumps({"page_id": 1, "url": "https://s", "html": html}) + "\n\n", "json")
    assert [r["version"] for r in release_pages.parse(registry.landed(spark, "pages", str(tmp_path / "p")), "release_notes").collect()] == ["26.2"]
    with pytest.raises(Exception, match="unknown kind"):
        registry.landed(spark, "nope", str(tmp_path / "p")).count()


def run(spark, tmp_path, fail=False):
    """One run of the stream into files by batch id; it may die after the sink has written."""

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"{number:04d}"))
        if fail:
            raise RuntimeError("gone after the sink")

    stream = registry.stream(spark, "rss_feed", str(tmp_path / "in"), str(tmp_path / "progress.json"), official_url="https://o")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()


def held(spark, tmp_path):
    return sorted(r["record_id"] for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect())


def test_progress_is_told_after_the_sink(spark, tmp_path):
    progress = tmp_path / "progress.json"
    land(tmp_path / "in", 1, RSS)
    with pytest.raises(Exception, match="gone after the sink"):
        run(spark, tmp_path, fail=True)
    assert held(spark, tmp_path) == ["g1", "https://a/2"] and not progress.exists()
    land(tmp_path / "in", 3, SPACED)  # the second is on its way: the third waits
    run(spark, tmp_path)
    assert held(spark, tmp_path) == ["g1", "https://a/2"]
    run(spark, tmp_path)
    land(tmp_path / "in", 2, MORE), land(tmp_path / "in", 3, MORE.replace("g3", "g5"))
    run(spark, tmp_path), run(spark, tmp_path)
    assert held(spark, tmp_path) == ["g1", "g3", "g5", "https://a/2", "https://a/4", "https://a/4"]
    assert json.loads(progress.read_text())["taken"] in (1, 3)


def test_adapters_may_be_added(spark):
    registry.register("mine", lambda spark, path, **_: spark.range(3))
    try:
        assert registry.read(spark, "mine", "").count() == 3
        with pytest.raises(ValueError, match="there already"):
            registry.register("mine", registry.ADAPTERS["mine"])
    finally:
        del registry.ADAPTERS["mine"]
    with pytest.raises(ValueError, match="has no stream"):
        registry.stream(spark, "issues", "")
