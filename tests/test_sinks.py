import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import publication, sinks


def lines(spark, path):
    return sorted((json.loads(r["value"]) for r in spark.read.text(path).collect()), key=lambda d: json.dumps(d, sort_keys=True))


def test_ledger_keeps_the_newest_of_each_source_and_replaces_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/seen"
    rows = spark.createDataFrame([("a", f"r{i}", i) for i in range(6)] + [("b", "x", 1)], "source string, id string, at int")
    sinks.save_ledger(rows, path, "source", [F.desc("at")], 3)
    assert {(r["source"], r["id"]) for r in spark.read.parquet(path).collect()} == {("a", "r5"), ("a", "r4"), ("a", "r3"), ("b", "x")}
    sinks.save_ledger(rows.where("source = 'b'"), path, "source", [F.desc("at")], 3)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["x"]
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


def test_json_reports_leave_nulls_out_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", None, "é\n\"q\"")], "k string, n int, t string")
    sinks.json_report(rows, f"{tmp_path}/report")
    assert lines(spark, f"{tmp_path}/report") == [{"k": "a", "n": 1}, {"k": "b", "t": 'é\n"q"'}]
    back = spark.read.schema(rows.schema).json(f"{tmp_path}/report")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    sinks.json_report(rows.limit(0), f"{tmp_path}/report")
    assert lines(spark, f"{tmp_path}/report") == []


def test_logs_are_split_by_their_reason(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "late"), (3, None), (4, "")], "id int, exclusion_reason string")
    sinks.split_log(rows, f"{tmp_path}/log")
    assert lines(spark, f"{tmp_path}/log/accepted") == [{"id": 1}, {"id": 3}]
    assert lines(spark, f"{tmp_path}/log/rejected") == [{"exclusion_reason": "", "id": 4}, {"exclusion_reason": "late", "id": 2}]


def test_nothing_is_published_with_a_bad_row(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.publish(spark.createDataFrame([(1,)], "n int"), path)
    with pytest.raises(ValueError, match="1 of 2 rows"):
        sinks.publish(spark.createDataFrame([(2,), (None,)], "n int"), path, F.col("n") > 0)
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [1]


def test_public_rows_say_the_issue_in_words(spark):
    fields = "id int, source_name string, source_type string, source_url string, report_title string, parent_title string, source_date string, matched_version string, update_version string, product_id string, issue_theme string, workflow_area string"
    rows = spark.createDataFrame([(1, None, "reddit_post", "u", "It crashes on start", None, "2026-01-02T03:00:00Z", None, "2.1", "obs-studio", "crash", "start_up"), (2,) + (None,) * 11], fields)
    one, two = publication.public_rows(rows).orderBy("id").collect()
    assert (one["source_name"], one["source_type"], one["source_title"], one["source_date"], one["version_matched"]) == ("reddit_post", "reddit post", "It crashes on start", "2026-01-02", "2.1")
    assert (two["source_name"], two["source_type"], two["source_title"], two["source_date"], two["version_matched"]) == ("Source", "community report", "Community report", "", "")
    assert one["issue"] and "_" not in one["issue"] and one["workflow_area"] == "start up"
