"""Registered queries of stateful streams: the events table lands in three parts, and the stream is started anew for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.registry import Tables, query
from ledgerloom.streaming import incremental, stateful

PARTS = 3


def started_anew(t: Tables, name: str, rows: DataFrame, moment: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream appends whose rows land in PARTS stretches of time, with a restart from the checkpoint after each."""
    folder = incremental.new_folder(t.spark, name)
    at = F.unix_micros(F.col(moment).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part: Column = F.lit(0) if low is None else F.least(F.floor((at - low) * PARTS / F.lit(max(1, high - low))), F.lit(PARTS - 1))
    for i in range(PARTS):
        rows.where(F.coalesce(part, F.lit(0)) == i).write.mode("append").parquet(f"{folder}/in")
        stream = build(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        stateful.append(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""
WITH e AS (
  SELECT *, lag(event_type) OVER w AS was,
         last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, event_type IS DISTINCT FROM was AS substantive_change,
       CASE WHEN event_type = 'view' THEN 'not_requested' WHEN event_type IS NOT DISTINCT FROM was THEN 'skipped_no_substantive_record_change'
            WHEN event_type IS NOT DISTINCT FROM said THEN 'skipped_latest_status_event_equivalent'
            ELSE 'applied_substantive_record_change' END AS event_reason
FROM e""")
def status_event_stream(t: Tables):
    """Status events of each user's record, whose field is the kind of the latest event; views ask for none."""
    note = F.struct(F.col("ts").cast("string").alias("at"), F.col("event_type").alias("label"), F.lit("seen").alias("note"))
    rows = t.events.select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") != "view", note).alias("event"))
    made = started_anew(t, "status", rows, "ts", lambda s: stateful.status_events(s, ["user_id"], ["ts", "event_id"], ["event_type"]))
    return made.select("user_id", "event_id", "event_type", "substantive_change", "event_reason")


@query("""
WITH now AS (
  SELECT user_id, event_id % 4 AS identity FROM events WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, identity, count(*) AS n FROM events JOIN now USING (user_id)
WHERE event_type <> 'purchase' AND event_id % 4 = identity GROUP BY ALL""")
def rollover_counts(t: Tables):
    """Reports that count for each user's present identity, which every purchase sets anew: the sum of a stream's signed deltas."""
    rows = t.events.select("user_id", "ts", "event_id", (F.col("event_id") % 4).alias("identity"), (F.col("event_type") != "purchase").alias("is_report"))
    made = started_anew(t, "rollover", rows, "ts", lambda s: stateful.rollover_deltas(s, ["user_id"], ["ts", "event_id"], "identity", "is_report"))
    return made.groupBy("user_id", "identity").agg(F.sum("delta").alias("n")).where("n <> 0")


@query("""
WITH r AS (SELECT user_id, min(ts) AS released FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.user_id, event_id, event_type,
       CASE WHEN released IS NULL THEN 'unknown_date' WHEN ts < released THEN 'early'
            WHEN min(ts) OVER (PARTITION BY e.user_id, event_type) < released THEN 'early_before' ELSE 'accepted' END AS verdict
FROM events e LEFT JOIN r ON e.user_id = r.user_id""")
def early_reports(t: Tables):
    """Events before a user's first signup are early; what a user did early is not opened again when it comes later."""
    releases = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("released"))
    rows = t.events.select("user_id", "ts", "event_id", "event_type", F.col("ts").cast("timestamp").alias("arrived"))
    gate = lambda s: stateful.date_gate(s, releases, ["user_id"], ["ts", "event_id"], "event_type", "ts", "released", "arrived", "40 days")
    return started_anew(t, "early", rows, "ts", gate).select("user_id", "event_id", "event_type", "verdict")
