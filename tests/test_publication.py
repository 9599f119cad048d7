import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ladders, text, versions
from ledgerloom.operators import publication, sinks, views


def test_suite_versions(spark):
    cases = {
        "DaVinci Resolve 21 Public Beta 1": ("21 Public Beta 1", True, None), "21b3": ("21 Public Beta 3", True, None), "Resolve Studio 20.1.2": ("20.1.2", False, None), "DaVinci Resolve Studio 21.0b1": ("21 Public Beta 1", True, None),
        "21": ("21", False, None), "v20.1": ("20.1", False, None), "DR21": (None, None, "abbreviation_dr_ambiguous"), "21.x": (None, None, "wildcard_version"), "Studio": (None, None, "studio_tier_not_a_version"),
        "21 beta": (None, None, "ambiguous_beta_no_number"), "hello": (None, None, "unrecognized_version_format"), "": (None, None, "empty_or_invalid_input"), "21 Studio": ("21", False, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", versions.normalize_suite(F.col("raw")).alias("v"))
    assert {r["raw"]: (r["v"]["version"], r["v"]["is_beta"], r["v"]["reason"]) for r in df.collect()} == cases


def test_coherence_fields(spark):
    rows = [("blackmagic-davinci", "21 Public Beta 1", 3, ""), ("blackmagic-davinci", "20.1", 1, ""), ("obs-studio", "32.1", 2, "archived"), ("obs-studio", "32.1", 2, None), ("adobe-premiere-pro", "26.2", 1, ""), ("x", "1", 5, ""), ("obs-studio", "1", 0, "")]
    df = spark.createDataFrame(rows, "p string, v string, n int, s string")
    made = publication.coherence(F.col("p"), F.col("v"), F.col("n"), F.lit("Name"), F.col("s"), F.array(F.lit("lag"), F.lit("crash")))
    got = [r["c"] for r in df.select(made.alias("c")).collect()]
    assert [g and g["quick_verdict"] for g in got] == [
        "WAIT for production systems: Name 21 Public Beta 1 is a beta build with 3 user reports found.", "WAIT: Name 20.1 has 1 user reports found.", "WAIT: Name 32.1 has 2 user reports found.",
        "TEST FIRST: Name 32.1 has 2 user reports found.", "WAIT: Name 26.2 has 1 user report found.", None, None,
    ]
    assert got[1]["body"].startswith("Current reports mention lag and crash. Production editors") and got[2]["body"].startswith("Name 32.1 is archived.") and len(got[3]["recommendations"]) == 3


def test_events_in_public_words(spark):
    df = spark.createDataFrame([([("a", "Verified reports set", "from YAML"), ("b", "Insufficient: collector", "evidence state x"), ("c", "Fine", "good"), ("d", "writeback", "n")],)], "e array<struct<at:string,label:string,note:string>>")
    (row,) = df.select(publication.clean_events(F.col("e")).alias("e")).collect()
    assert [(e["label"], e["note"]) for e in row["e"]] == [
        ("User reports found", "User report count updated after the latest evidence pass."), ("Insufficient data", "Record status updated after the latest source check."), ("Fine", "good"), ("Record updated", "n"),
    ]


def test_a_collector_publishes_all_or_nothing(spark, tmp_path):
    shape, path = "id string, product_id string, n int", f"{tmp_path}/t"
    stored = spark.createDataFrame([("1", "p", 1)], shape)
    sinks.publish(stored, path)
    stored, owner = spark.createDataFrame(stored.collect(), shape), {"product_id": {"p"}}
    act = lambda *rows: sinks.transact(stored, spark.createDataFrame([("1", "p", 1), *rows], shape), path, owner, F.col("n") > 0, ["id"])
    assert act(("2", "q", 1)) == (False, "new_row_outside_allow_list: 1") and act(("2", "p", -1))[0] is False and act(("1", "p", 2)) == (False, "repeated keys: 1")
    assert sinks.transact(stored, spark.createDataFrame([("2", "p", 1)], shape), path, owner, F.col("n") > 0, ["id"]) == (False, "existing_row_changed_or_deleted: 1")
    assert spark.read.parquet(path).count() == 1
    assert act(("2", "p", 5)) == (True, "") and spark.read.parquet(path).count() == 2


def test_dates_are_refreshed_only_if_all_rows_hold(spark):
    records = spark.createDataFrame([("p", "old"), ("q", "old")], "product_id string, evidence_last_checked string")
    rows = spark.createDataFrame([("p", True), ("p", True), ("q", True), ("q", False)], "product_id string, ok boolean")
    done = lambda n: {r["product_id"]: r["evidence_last_checked"] for r in sinks.refresh_dates(records, rows.where(f"product_id = '{n}'"), ["product_id"], 2, {"ok": F.col("ok")}, F.lit("new")).collect()}
    assert done("p") == {"p": "new", "q": "old"} and done("q") == {"p": "old", "q": "old"}


def test_flags_and_cards(spark):
    assert publication.active({"A": "true", "B": "True"}, {"x": "A", "y": "B", "z": "", "w": "C"}) == ["x", "z"]
    cards = spark.createDataFrame([("u1", "?"), ("u9", "Two"), ("u8", "?")], "url string, product_name string")
    pages = spark.createDataFrame([("u1", "p1")], "url string, product_id string")
    products = spark.createDataFrame([("p1", "One", "c", ""), ("p2", "two", "c", "own")], "product_id string, name string, company_id string, logo string")
    companies = spark.createDataFrame([("c", "C", "theirs")], "company_id string, company string, logo string")
    got = {r["url"]: (r["product_id"], r["company"], r["logo"]) for r in publication.card_enrichment(cards, pages, products, companies).collect()}
    assert got == {"u1": ("p1", "C", "theirs"), "u9": ("p2", "C", "own"), "u8": (None, None, "")}


def test_statuses_and_signatures(spark):
    df = spark.createDataFrame([(3, 0, 3, 1, "x", True), (0, 0, 0, 1, "captcha", False), (0, 0, 0, 0, "", True)], "c int, a int, r int, e int, why string, tried boolean")
    for policy, wanted in {"forum": ["partial", "blocked", "no_results"], "threads": ["partial", "blocked", "no_results"], "answers": ["partial", "blocked", "no_results"], "fallback": ["partial", "disabled", "no_results"]}.items():
        made = ladders.method_status(policy, *[F.col(x) for x in "care"], F.col("why"), F.lit(0), F.col("tried"))
        assert [r[0] for r in df.select(made).collect()] == wanted, policy
    with pytest.raises(KeyError):
        ladders.method_status("none", *[F.col(x) for x in "care"])


def test_release_note_texts(spark):
    notes = "## What's Changed\n* Fix by @me in https://github.com/a/b/pull/12\n**Full Changelog**: https://github.com/a/b/compare/1...2\n- `code` and [link](x)"
    df = spark.createDataFrame([(notes,), ("",), ("word " * 200,)], "t string")
    got = df.select(text.normal_notes(F.col("t")).alias("n"), text.summarize(F.col("t")).alias("s")).collect()
    assert got[0]["n"].split("\n")[:3] == ["## Changes", "* Fix by @me ([PR #12](https://github.com/a/b/pull/12))", "[Full changelog](https://github.com/a/b/compare/1...2)"]
    assert got[0]["s"] == "Changes Fix by @me (PR #12) Full changelog code and link"
    assert got[1]["s"].startswith("Official release notes were detected") and len(got[2]["s"]) <= 420 and got[2]["s"].endswith("word.")


def test_texts_that_hold_needles(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox"), (2, "xaby"), (3, "quick brow"), (4, "é"), (5, None), (6, "")], "doc int, t string")
    needles = spark.createDataFrame([(1, "quick brown f"), (2, "ab"), (3, "é"), (4, "e q"), (5, ""), (6, "ck brow"), (7, "nothing at all")], "item int, n string")
    got = sorted((r["doc"], r["item"]) for r in views.holding(texts, "doc", "t", needles, "item", "n").collect())
    assert got == [(1, 1), (1, 4), (1, 6), (2, 2), (3, 6), (4, 3)]
    assert [(r["doc"], r["item"]) for r in views.holding(texts, "doc", "t", needles.where("item = 1"), "item", "n").collect()] == [(1, 1)]
