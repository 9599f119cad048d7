import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import consensus, dedupe, gates, health, reconcile, sinks, temporal, views

NOW = dt.datetime(2026, 7, 15)
FRESH, STALE, PRE, FUTURE = (dt.datetime(2026, m, d) for m, d in ((7, 10), (6, 15), (5, 15), (8, 1)))
LADDER = {
    "c1": ([("success", FRESH), ("success", STALE)], 0, "INSUFFICIENT COVERAGE"),
    "c2": ([("no_results", FRESH)] * 2, 0, "NO ACCEPTED PATCH-SPECIFIC REPORTS"),
    "c3": ([("blocked", FRESH), ("success", STALE)], 0, "COLLECTION BLOCKED"),
    "c4": ([("no_results", FRESH)] * 2 + [("manual_review_needed", FRESH)], 0, "MONITORING DEGRADED"),
    "c5": ([("no_results", FRESH)] * 2 + [("stale", FRESH)], 0, "MONITORING DEGRADED"),
    "c6": ([("success", PRE)] * 2, 0, "NOT YET MONITORED"),
    "c7": ([("success", FRESH)], 0, "INSUFFICIENT COVERAGE"),
    "c8": ([("success", FRESH), ("blocked", FRESH)], 0, "MONITORING DEGRADED"),
    "c9": ([("no_results", FRESH)] * 2 + [("disabled", FRESH)], 0, "MONITORING DEGRADED"),
    "c10": ([("disabled", FRESH)] * 2, 0, "OFFICIAL SOURCE ONLY"),
    "c11": ([("no_results", FRESH)] * 2 + [("success", FUTURE)], 0, "MONITORING DEGRADED"),
    "c12": ([("success", FUTURE)], 0, "COLLECTION STALE"),
    "c14": ([("no_results", FRESH)] * 2, 3, "MONITORING ACTIVE"),
    "c15": ([], 0, "OFFICIAL SOURCE ONLY"),
    "c16": ([("success", STALE), ("no_results", STALE)], 0, "COLLECTION STALE"),
}


def test_monitoring_ladder(spark):
    records = spark.createDataFrame([(k, dt.datetime(2026, 6, 1), v[1]) for k, v in LADDER.items()], "pid string, published timestamp, reports int")
    methods = spark.createDataFrame([(k, s, at) for k, v in LADDER.items() for s, at in v[0]], "pid string, status string, last_run timestamp")
    found = health.monitoring_ladder(records, methods, ("pid",), F.lit(NOW), "published", "reports")
    assert {r["pid"]: r["monitoring_status"] for r in found.collect()} == {k: v[2] for k, v in LADDER.items()}


def test_windows_identity(spark):
    target = ("26100.8737", "KB5095093", "24H2", "2026-06-01")
    cases = [
        (("26100.8737", None, None, "2026-06-02"), None), ((None, "KB5095093", "24H2", "2026-06-02"), None),
        ((None, "KB5095093", "25H2", "2026-06-02"), "wrong_feature_train_for_kb"), ((None, "KB1", "24H2", "2026-06-02"), "stale_due_to_patch_rollover"),
        ((None, None, None, "2026-06-02"), "missing_kb_or_build"), (("26100.8737", None, None, "2026-05-01"), "source_date_before_target_release_date"),
    ]
    rows = [(*c[0], *target, "24H2") for c in cases] + [("26100.8737", None, None, "2026-06-02", None, None, "24H2", None, "24H2")]
    schema = "matched_os_build string, matched_kb string, matched_feature_version string, source_date string, target_os_build string, target_kb string, target_feature_version string, target_release_date string, update_version string"
    found = spark.createDataFrame(rows, schema).select(gates.first_failure(gates.windows_identity()).alias("r")).collect()
    assert [r["r"] for r in found] == [c[1] for c in cases] + ["windows_record_missing_target_identity"]


def evidence(spark, **rows):
    base = dict.fromkeys(f.split()[0] for f in schemas.EVIDENCE.replace("\n", " ").split(",") if f.strip())
    made = [{**base, "id": k, "patch_version_matched": True, "source_url": "https://github.com/a/b/issues/1", "sentiment": "negative", **v} for k, v in rows.items()]
    return spark.createDataFrame(made, schemas.EVIDENCE)


def test_gates_report_the_first_failure(spark):
    rows = evidence(
        spark, ok={}, version={"patch_version_matched": None, "source_url": ""}, url={"source_url": "https://github.com/a/b"},
        early={"source_date_pass": False}, ungated={"source_date_pass": None}, quiet={"report_title": "all good"},
    )
    text = F.coalesce("report_title", F.lit("a crash"))
    found = gates.gated(rows, gates.acceptance(text, ("crash",)))
    assert {r["id"]: r["exclusion_reason"] for r in found.collect()} == {
        "ok": None, "version": "missing_exact_patch_version_match", "url": "source_url_not_specific_report",
        "early": "source_date_before_or_unverified_against_release", "ungated": None, "quiet": "not_a_real_issue_report",
    }
    rows = evidence(
        spark, ok={"severity": ""}, url={"source_url": " "}, match={"patch_version_matched": None}, counted={"counted": False}, null={"counted": None},
        mood={"sentiment": "angry"}, sev={"severity": "huge"},
    )
    found = gates.gated(rows.drop("exclusion_reason"), gates.inclusion())
    assert {r["id"]: r["exclusion_reason"] for r in found.collect()} == {
        "ok": None, "url": "gate_11_missing_source_url", "match": "gate_12_patch_version_matched_false", "counted": "gate_13_counted_false", "null": None,
        "mood": "invalid_sentiment", "sev": "invalid_severity",
    }


def test_tri_state_counts(spark):
    rows = spark.createDataFrame([(c, m) for c in (True, False, None) for m in (True, False, None)], "counted boolean, patch_version_matched boolean")
    assert rows.where(gates.authoritative(F.col("counted"), F.col("patch_version_matched"))).count() == 2


def test_as_of(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([("a", 1, day(1)), ("a", 2, day(5)), ("a", 3, day(9)), ("b", 4, day(9))], "k string, id int, at timestamp")
    starts = spark.createDataFrame([("a", "v1", day(5)), ("a", "v2", day(8)), ("a", "v3", day(8))], "k string, version string, start timestamp")
    found = temporal.active_at(events, starts, ("k",), "at", "start", "version", ("version", "start"))
    assert {r["id"]: r["version"] for r in found.collect()} == {1: None, 2: "v1", 3: "v3", 4: None}


def test_as_of_on_a_hot_key(spark):
    """One key with all but a few rows is cut into stretches of about equal size, and gives the same rows."""
    rng = random.Random(6)
    events = [("h" if i % 50 else f"k{i % 7}", i, None if i % 97 == 0 else int(rng.expovariate(0.01))) for i in range(3000)]
    starts = [("h", f"v{i}", int(rng.expovariate(0.01))) for i in range(300)] + [("h", "late", 5000), ("h", "none", None), ("k1", "w", 40)]
    e = spark.createDataFrame(events, "k string, id int, at int")
    w = spark.createDataFrame(starts, "k string, version string, start int")
    found = temporal.active_at(e, w, ("k",), "at", "start", "version", ("version", "start"), parts=4, splits=16, least=100)
    low = lambda v: (v is not None, v or 0)
    wanted = {}
    for k, i, at in events:
        before = [(low(s), v) for key, v, s in starts if key == k and low(s) <= low(at)]
        wanted[i] = max(before)[1] if before else None
    assert {r["id"]: r["version"] for r in found.collect()} == wanted
    (borders,) = (r["borders"] for r in temporal._hot(e.select("k", "at"), ("k",), 4, 16, 100).collect())
    sizes = Counter(sum(b <= at for b in borders) for k, _, at in events if k == "h" and at is not None)
    assert len(sizes) == 16 and max(sizes.values()) <= 3 * sorted(sizes.values())[8]


def test_representatives_keep_whole_buckets_apart(spark):
    """Against a plain version, on one hot group and bucket with ties."""
    rng = random.Random(2)
    rows = [("hot" if i % 10 else f"g{i % 30}", rng.choice("aaaab"), rng.randrange(1, 5), i) for i in range(2000)] + [("few", "z", 1, 9000)]
    df = spark.createDataFrame(rows, "k string, bucket string, sev int, arrival int")
    got = consensus.representatives(df, ("k",), "bucket", F.col("sev"), "arrival", 3).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[3]))
        sizes = Counter(r[1] for r in mine)
        order = sorted(sizes, key=lambda b: (-sizes[b], min(r[3] for r in mine if r[1] == b)))
        heads = [next(r for r in mine if r[1] == b) for b in order]
        wanted = [r[3] for r in (heads + [r for r in mine if r not in heads])[:3]]
        assert [r["arrival"] for r in sorted(got, key=lambda r: r["place"]) if r["k"] == key] == wanted


def test_version_window_prefers_its_channel(spark):
    w = spark.createDataFrame([("p", "1", "beta", 1), ("p", "1", "stable", 2)], "p string, v string, channel string, window_start int")
    m = spark.createDataFrame([("p", "1", "stable"), ("p", "1", "rc"), ("p", "2", "stable")], "p string, v string, channel string")
    got = temporal.window_for_version(m, w, "p", "v", "channel").collect()
    assert sorted((r["v"], r["channel"], r["window_channel"]) for r in got if r["window_channel"]) == [("1", "rc", "beta"), ("1", "stable", "stable")]


def test_window_of_a_version_without_pairs(spark):
    m = spark.createDataFrame([(i, "p", "1", c) for i, c in enumerate(["a", "z", None] * 20)] + [(60, "p", "2", "a"), (61, "p", None, "a")], "id int, p string, v string, channel string")
    w = [("p", "1", "a", None), ("p", "1", "a", 7), ("p", "1", "b", 3), ("p", "1", None, 5)] + [("p", "1", "c", 100 + i) for i in range(500)]
    found = temporal.window_for_version(m, spark.createDataFrame(w, "p string, v string, channel string, window_start int"), "p", "v", "channel")
    got = sorted((r["id"], r["window_channel"], r["window_start"]) for r in found.collect())
    assert got == [(i, *(("a", 7) if i % 3 == 0 else ("b", 3))) for i in range(60)] + [(60, None, None), (61, None, None)]
    # rows are ranked by no window: no mention is multiplied by its version's windows
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sections_and_carry(spark):
    rows = spark.createDataFrame([("p", "A one B two")], "id string, text string")
    heads = F.expr("array(named_struct('heading', 'A', 'start', 1), named_struct('heading', 'B', 'start', 7))")
    got = temporal.sections(rows, "id", heads, F.col("text")).orderBy("nth").collect()
    assert [(r["heading"], r["body"]) for r in got] == [("A", " one "), ("B", " two")]
    lines = spark.createDataFrame([("k", 1, "T1"), ("k", 2, None), ("k", 3, "clear"), ("k", 4, None)], "k string, n int, h string")
    value = F.when(F.col("h") != "clear", F.col("h"))
    got = temporal.carry_forward(lines, ("k",), ("n",), value, "track", F.coalesce(F.col("h") == "clear", F.lit(False))).orderBy("n").collect()
    assert [r["track"] for r in got] == ["T1", "T1", None, None]


def test_append_new(spark):
    stored = spark.createDataFrame([("1", "u1")], "id string, url string")
    new = spark.createDataFrame([("1", "u9", 0, False), ("2", "u1", 1, False), ("3", "u2", 2, False), ("4", "u2", 3, False), ("5", "u1", 4, True)], "id string, url string, n int, card boolean")
    got = dedupe.append_new(new, stored, ["id"], ["url"], F.col("card"), "n")
    assert sorted(r["id"] for r in got.collect()) == ["3", "5"]


def test_upsert_and_ownership(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), (" ", 5), (None, 6)], "k string, v int")
    got = {r["k"]: (r["v"], r["change"]) for r in dedupe.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {"a": (1, "unchanged"), "b": (3, "replaced"), "c": (4, "inserted")}
    bad = reconcile.ownership_violations(old, spark.createDataFrame([("a", 1), ("z", 9)], "k string, v int"), {"k": {"a", "b"}})
    assert sorted((r["k"], r["reason"]) for r in bad.collect()) == [("b", "existing_row_changed_or_deleted"), ("z", "new_row_outside_allow_list")]
    with pytest.raises(ValueError, match="protected"):
        reconcile.guarded_fields({"title"}, {"title"}, {"title"})


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    good = spark.createDataFrame([(1,), (2,)], "v int")
    assert sinks.publish(good, path, F.col("v") > 0) == 2
    with pytest.raises(ValueError, match="1 of 2"):
        sinks.publish(spark.createDataFrame([(1,), (-1,)], "v int"), path, F.col("v") > 0)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert sinks.publish(good.where("v = 1"), path) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]


def test_views(spark):
    rows = spark.createDataFrame([(1, "WAIT", 5), (2, "AVOID", 1), (3, "WAIT", 9)], "id int, verdict string, at int").withColumn("name", F.lit("n"))
    assert [r["id"] for r in views.sort_feed(rows, "risk", "name", "name", "verdict", "at", "id").collect()] == [2, 3, 1]
    terms = views.banned_terms(spark.createDataFrame([(1, "gate_1 fails", "x")], "id int, a string, b string"), "id", ["a", "b"], ("gate_",))
    assert [(r["field"], r["term"]) for r in terms.collect()] == [("a", "gate_")]
    errors = health.validation_errors(spark.createDataFrame([("", "odd", "x", -1)], "pid string, status string, last_run string, n int"), ("pid",), ("n",), ("success",), "last_run")
    assert errors.first()["errors"] == ["missing pid", "unknown status", "bad last_run", "negative n"]
