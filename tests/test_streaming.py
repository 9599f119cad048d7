from pyspark.sql import functions as F

from ledgerloom.streaming import incremental

SCHEMA = "pid string, record string, pos int, failed boolean, mood string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).json(folder)


def test_ingest_appends_each_record_once(spark, tmp_path):
    landing, store, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "store", "ck"))
    land(spark, landing, [("p", "1", 0, False, "x"), ("p", "2", 1, False, "x"), ("p", "3", 2, False, "x"), ("q", "1", 0, False, "x")])
    incremental.ingest(stream(spark, landing), store, checkpoint, "pid", "record", "pos", limit=2)
    land(spark, landing, [("p", "2", 0, False, "x"), ("p", "4", 1, False, "x"), ("p", "4", 2, False, "x")])
    incremental.ingest(stream(spark, landing), store, checkpoint, "pid", "record", "pos", limit=2)
    found = incremental.read_store(spark, store, SCHEMA)
    assert sorted((r["pid"], r["record"]) for r in found.collect()) == [("p", "1"), ("p", "2"), ("p", "3"), ("p", "4"), ("q", "1")]
    assert incremental.read_deferred(spark, store, SCHEMA).isEmpty()


def test_deferred_records_are_taken_up_by_later_runs(spark, tmp_path):
    landing, store, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "store", "ck"))
    land(spark, landing, [("p", str(i), i, False, "x") for i in range(5)])
    held = []
    for _ in range(5):  # nothing new lands after the first run
        incremental.ingest(stream(spark, landing), store, checkpoint, "pid", "record", "pos", limit=2)
        held.append(sorted(r["record"] for r in incremental.read_store(spark, store, SCHEMA).collect()))
    assert held == [["0", "1"], ["0", "1", "2", "3"], ["0", "1", "2", "3", "4"], ["0", "1", "2", "3", "4"], ["0", "1", "2", "3", "4"]]
    land(spark, landing, [("p", "9", 0, False, "x"), ("p", "1", 0, False, "x")])
    incremental.ingest(stream(spark, landing), store, checkpoint, "pid", "record", "pos", limit=2)
    assert [r["record"] for r in incremental.read_store(spark, store, SCHEMA).where("pos = 0").orderBy("record").collect()] == ["0", "9"]


def test_failure_states_carry_over(spark, tmp_path):
    landing, checkpoint = f"{tmp_path}/in", f"{tmp_path}/ck"
    seen = {}

    def collect(rows, _):
        seen.update({r["pid"]: (r["runs"], r["consecutive_failures"], r["state"]) for r in rows.collect()})

    for rows in ([("p", "a", 0, False, ""), ("p", "b", 1, True, ""), ("q", "a", 0, True, "")], [("p", "c", 2, True, ""), ("q", "b", 1, False, "")]):
        land(spark, landing, rows)
        out = incremental.failure_states(stream(spark, landing), "pid", "pos", "failed")
        incremental.available_now(out.writeStream.outputMode("update").foreachBatch(collect), checkpoint)
    assert seen == {"p": (3, 2, "failing"), "q": (2, 0, "healthy")}


def test_running_consensus(spark, tmp_path):
    landing = f"{tmp_path}/in"
    land(spark, landing, [("p", "1", 0, False, "negative"), ("p", "2", 0, False, "negative"), ("q", "1", 0, False, "positive")])
    out = incremental.running_consensus(stream(spark, landing), ("pid",), "mood")
    query = out.writeStream.outputMode("complete").format("memory").queryName("verdicts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["pid"]: r["label"] for r in spark.table("verdicts").select("pid", F.col("label")).collect()} == {"p": "Negative", "q": "Positive"}
