import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import publication
from ledgerloom.streaming import stateful
from ledgerloom.streaming.ledger import Ledger, Run

EVENT = "struct<at:string,label:string,note:string>"
PROPOSED = f"product_id string, update_version string, pos int, n int, event {EVENT}"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{folder}/in")


def test_status_events_over_batches_and_a_restart(spark, tmp_path):
    """Two micro-batches with a restart between them decide what the batch plan decides step by step."""
    say = lambda label, note="x": ("2026", label, note)
    stored = [("p", "1", 3, say("Published")), ("q", "1", 0, None)]
    batches = [
        [("p", "1", 1, 3, say("Counted")), ("p", "1", 2, 4, say(" published ")), ("q", "1", 1, 1, None), ("r", "1", 1, 1, say("YAML reports"))],
        [("p", "1", 3, 5, say("Counted")), ("q", "1", 2, 1, say("Counted")), ("r", "1", 2, 2, say("User reports found", "X")), ("p", "1", 4, 6, say("counted"))],
    ]
    first = spark.createDataFrame(stored, f"product_id string, update_version string, n int, event {EVENT}")
    keys, order = ["product_id", "update_version"], ["pos"]
    for rows in batches:
        stream = stateful.status_events(land(spark, tmp_path, rows, PROPOSED), keys, order, ["n"], first)
        stateful.append(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r["product_id"], r["pos"]): (r["substantive_change"], r["event_reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the batch plan, one proposal a record at a time
    held = {k[:2]: (k[2], [k[3]] if k[3] else []) for k in stored}
    wanted = {}
    for rows in batches:
        for pid, version, pos, n, event in sorted(rows, key=lambda r: r[2]):
            was, events = held.get((pid, version), (None, []))
            a = spark.createDataFrame([(pid, version, was, events)], f"product_id string, update_version string, n int, status_events array<{EVENT}>")
            b = spark.createDataFrame([(pid, version, n, event)], f"product_id string, update_version string, n int, event {EVENT}")
            (made,) = publication.write_plan(a, b, ["n"]).collect()
            held[pid, version] = (made["n"], [tuple(e) for e in made["status_events"]])
            wanted[pid, pos] = (made["substantive_change"], made["event_reason"])
    assert got == wanted
    assert Counter(r for _, r in got.values())["applied_substantive_record_change"] == 2


def test_rollovers_take_old_evidence_out(spark, tmp_path):
    """After three rollovers, and back to an old identity, the deltas add up to a recompute; nothing is counted twice after a restart."""
    rng = random.Random(4)
    rows = []
    for pid in "abc":
        for i in range(80):
            rows.append((pid, i, f"v{rng.randrange(4)}", True))
        for i, v in ((5, "v0"), (30, "v1"), (50, "v2"), (70, "v0")):
            rows.append((pid, 100 * i, v, False) if pid == "c" else (pid, i, v, False))
        rows.append((pid, 81, None, True))
    rows = [(p, 2 * i + (not e), v, e) for p, i, v, e in rows]
    schema = "pid string, pos int, identity string, is_report boolean"
    early = [r for r in rows if r[1] < 90]
    for part in (early, [r for r in rows if r[1] >= 90]):
        rng.shuffle(part)  # order within a batch does not matter
        out = stateful.rollover_deltas(land(spark, tmp_path, part, schema), ["pid"], ["pos"], "identity", "is_report")
        stateful.append(out, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r["pid"], r["identity"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("pid", "identity").agg(F.sum("delta").alias("n")).collect() if r["n"]}
    current = {p: max((r for r in rows if r[0] == p and not r[3]), key=lambda r: r[1])[2] for p in "abc"}
    assert got == {(p, v): sum(r[0] == p and r[2] == v and r[3] for r in rows) for p, v in current.items()}
    changes = {r["change"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert changes == {"counted", "retracted", "restored"}


def test_early_reports_are_listed_and_never_opened_again(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    releases = spark.createDataFrame([("p", day(10)), ("q", None)], "pid string, released timestamp")
    schema = "pid string, report string, dated timestamp, arrived timestamp"
    batches = [
        [("p", "a", day(12), day(11)), ("p", "b", day(9), day(12)), ("q", "c", day(1), day(12)), ("p", "d", None, day(12))],
        [("p", "b", day(15), day(16)), ("p", "e", day(30), day(14)), ("p", "f", day(10), day(15)), ("p", "g", day(2), day(13))],
        [("z", "x", day(1), day(500))],  # the watermark moves on, and what was remembered goes
        [("p", "b", day(15), day(501))],
    ]
    held = []
    for rows in batches:
        out = stateful.date_gate(land(spark, tmp_path, rows, schema), releases, ["pid"], ["arrived"], "report", "dated", "released", "arrived", "5 days", 60)
        run = stateful.append(out, f"{tmp_path}/out", f"{tmp_path}/ck")
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r["report"], r["arrived"]): r["verdict"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", day(11)): "accepted", ("b", day(12)): "early", ("c", day(12)): "unknown_date", ("d", day(12)): "unknown_date", ("b", day(16)): "early_before",
        ("e", day(14)): "accepted", ("f", day(15)): "accepted", ("g", day(13)): "early", ("x", day(500)): "unknown_date", ("b", day(501)): "accepted",
    }
    assert held[0] > 0 and held[-1] == 0  # state is bounded: only early reports are held, and not for ever


def test_ledger_reads_a_level_number_of_files(spark, tmp_path):
    """Over 50 batches a batch's reads do not grow with the history, and no key is lost or seen too early."""
    schema = spark.createDataFrame([], "pid string, record int").schema
    ledger = Ledger(spark, f"{tmp_path}/seen", schema, buckets=4, fan=4)
    read = []
    for batch in range(50):
        rows = spark.createDataFrame([("p", 2 * batch + k) for k in (0, 1, -1)] + [(None, batch // 2)], schema)
        ledger.merge(before=batch)
        if batch % 7 == 3:
            seen = ledger.read(rows, before=batch)
            read.append(len(seen.inputFiles()))
            new = {tuple(r) for r in ledger.unseen(rows, before=batch).collect()}
            assert new == {("p", 2 * batch), ("p", 2 * batch + 1)} | ({(None, batch // 2)} if batch % 2 == 0 else set())
        ledger.add(rows, batch)
        if batch == 20:  # again after a failure: its own run is replaced, the ledger before it is the same
            ledger.merge(before=batch)
            assert ("p", 40) in {tuple(r) for r in ledger.unseen(rows, before=batch).collect()}
            ledger.add(rows, batch)
    assert {tuple(r) for r in ledger.read().distinct().collect()} == {("p", k) for k in range(-1, 100)} | {(None, k) for k in range(25)}
    assert len(ledger.runs()) <= 4 * 3 + 1 and max(read) <= 4 * (4 * 3 + 1) and max(read[-3:]) <= 2 * max(read[:4])
    only = ledger.read(spark.createDataFrame([("p", 7)], schema)).inputFiles()
    assert len({f.split("bucket=")[1][0] for f in only}) <= 4


def test_runs_that_another_holds_do_not_count_twice(spark, tmp_path):
    schema = spark.createDataFrame([], "k int").schema
    ledger = Ledger(spark, f"{tmp_path}/seen", schema, fan=2)
    assert ledger.read() is None and ledger.runs() == []
    for batch in range(2):
        ledger.add(spark.createDataFrame([(batch,)], schema), batch)
    ledger._write(spark.createDataFrame([(0,), (1,)], schema), Run(1, 0, 1))  # merged, and the machine was lost before the old runs went
    assert ledger.runs() == [Run(1, 0.0, 1.0)] or [r.level for r in ledger.runs()] == [1]
    assert sorted(r["k"] for r in ledger.read().collect()) == [0, 1]
    ledger.merge(before=2)
    assert sorted(r["k"] for r in ledger.read().collect()) == [0, 1] and len(ledger.runs()) == 1
