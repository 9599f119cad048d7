"""Timelines: release windows over orders, attribution and health over events. Clocks are fixed."""

from __future__ import annotations


from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import consensus, dedupe, health, temporal, views
from ledgerloom.registry import Tables, query
from ledgerloom.streaming import incremental

NOW = "TIMESTAMP '2024-07-01 00:00:00'"


@query("""
SELECT o_custkey AS product_id, o_orderkey AS version, o_orderdate AS window_start,
       lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS window_end
FROM orders""")
def release_windows(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("window_start"))
    return temporal.release_windows(rows, ("product_id",), "window_start", F.col("version"))


ASOF = """
SELECT e.event_id, e.user_id, e.ts, s.event_id AS release_id, s.ts AS release_ts
FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s
ON e.user_id = s.user_id AND e.ts >= s.ts"""


@query(ASOF)
def active_window_asof(t: Tables):
    errors = t.events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    starts = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("release_id"), F.col("ts").alias("release_ts"))
    found = temporal.active_at(errors, starts, ("user_id",), "ts", "release_ts", "release_id", ("release_id", "release_ts"))
    return found.select("event_id", "user_id", "ts", "release_id", "release_ts")


@query(f"SELECT event_id, release_id, coalesce(abs(epoch(ts) - epoch(release_ts)) < 86400, false) AS near FROM ({ASOF})")
def near_boundary(t: Tables):
    rows = active_window_asof(t)
    return rows.select("event_id", "release_id", dates.near_boundary(F.col("ts"), F.col("release_ts"), F.lit(None).cast("timestamp_ntz")).alias("near"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
FROM events""")
def carry_forward(t: Tables):
    value = F.when(F.col("event_type") == "signup", F.col("value"))
    return temporal.carry_forward(t.events, ("user_id",), ("ts", "event_id"), value, "carried").select("event_id", "user_id", "carried")


@query("SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id")
def latest_checked(t: Tables):
    found = consensus.latest(t.events.withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), ("user_id",), "at")
    return found.select("user_id", F.col("latest").cast("timestamp_ntz").alias("latest"))


LADDER = f"""
WITH m AS (
  SELECT user_id, event_type, max(ts) AS last_run FROM events GROUP BY ALL),
s AS (SELECT *, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'no_results' WHEN 'signup' THEN 'partial' WHEN 'purchase' THEN 'disabled' ELSE 'blocked' END AS status FROM m),
r AS (SELECT c_custkey, c_nationkey, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * c_nationkey AS pub FROM customer),
a AS (
  SELECT c_custkey, count(*) AS total, count(*) FILTER (status = 'disabled') AS disabled,
         count(*) FILTER (status <> 'disabled' AND last_run <= {NOW} AND last_run >= pub AND epoch({NOW}) - epoch(last_run) <= 14 * 86400) AS fresh,
         count(*) FILTER (status IN ('success', 'no_results') AND last_run <= {NOW} AND last_run >= pub AND epoch({NOW}) - epoch(last_run) <= 14 * 86400) AS healthy,
         bool_or(status <> 'disabled' AND last_run <= {NOW}) AS valid, bool_or(status <> 'disabled' AND last_run <= {NOW} AND last_run >= pub) AS post,
         bool_or(status IN ('blocked', 'broken')) AS blocked, bool_or(status IN ('partial', 'blocked', 'broken')) AS degraded,
         bool_or(status <> 'disabled' AND last_run > {NOW}) AS invalid
  FROM s JOIN r ON user_id = c_custkey GROUP BY c_custkey)
SELECT r.c_custkey AS product_id, coalesce(total, 0) AS methods, coalesce(healthy, 0) AS healthy_methods,
       CASE WHEN coalesce(total, 0) = 0 OR disabled = total THEN 'OFFICIAL SOURCE ONLY' WHEN NOT valid THEN 'COLLECTION STALE' WHEN NOT post THEN 'NOT YET MONITORED'
            WHEN fresh = 0 THEN 'COLLECTION STALE' WHEN healthy = 0 AND blocked THEN 'COLLECTION BLOCKED' WHEN degraded OR disabled > 0 OR invalid THEN 'MONITORING DEGRADED'
            WHEN healthy < 2 THEN 'INSUFFICIENT COVERAGE' WHEN c_nationkey > 12 THEN 'MONITORING ACTIVE' ELSE 'NO ACCEPTED PATCH-SPECIFIC REPORTS' END AS monitoring_status
FROM r LEFT JOIN a ON r.c_custkey = a.c_custkey"""


@query(LADDER)
def monitoring_ladder(t: Tables):
    status = F.create_map(*[F.lit(x) for p in (("view", "success"), ("click", "no_results"), ("signup", "partial"), ("purchase", "disabled"), ("error", "blocked")) for x in p])
    methods = t.events.groupBy(F.col("user_id").alias("product_id"), "event_type").agg(F.max("ts").alias("last_run")).withColumn("status", F.try_element_at(status, F.col("event_type")))
    published = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(c_nationkey)")
    records = t.customer.select(F.col("c_custkey").alias("product_id"), published.alias("pub"), F.when(F.col("c_nationkey") > 12, 1).otherwise(0).alias("reports"))
    found = health.monitoring_ladder(records.withColumnRenamed("pub", "published"), methods, ("product_id",), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "published", "reports")
    return found.select("product_id", "methods", "healthy_methods", "monitoring_status")


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events),
s AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n FROM e)
SELECT event_id, user_id, n AS consecutive_failures, CASE WHEN n = 0 THEN 'healthy' WHEN n = 1 THEN 'degraded' ELSE 'failing' END AS state FROM s""")
def failure_streak(t: Tables):
    found = health.failure_streaks(t.events, ("user_id",), ("ts", "event_id"), F.col("event_type") == "error")
    return found.select("event_id", "user_id", "consecutive_failures", "state")


@query("""
SELECT event_id, user_id, CASE WHEN event_type <> 'error' AND nth <= 2 THEN 'create' WHEN event_type <> 'error' THEN 'defer' WHEN nth <= 2 THEN 'refresh' ELSE 'skip' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS nth FROM events)""")
def write_quota(t: Tables):
    return dedupe.write_quota(t.events, "user_id", F.col("event_type") == "error", [F.col("ts"), F.col("event_id")], 2).select("event_id", "user_id", "action")


@query("""
WITH s AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY user_id, event_type),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS place FROM s)
SELECT user_id, string_agg(event_type, ', ' ORDER BY seen) AS "values" FROM p WHERE place <= 4 GROUP BY user_id""")
def ordered_distinct4(t: Tables):
    return consensus.ordered_distinct(t.events, ("user_id",), "event_type", "event_id")


@query("""
SELECT coalesce(year(o_orderdate)::VARCHAR, 'undated') AS year, count(*) AS n FROM orders
WHERE NOT coalesce(year(o_orderdate) * 100 + month(o_orderdate) >= 1997 * 100 + 12, false) GROUP BY ALL""")
def year_archive(t: Tables):
    return views.by_year(t.orders, "o_orderdate", views.is_recent("o_orderdate", 1998))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS day, floor((epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate)) / 86400) >= 365 AS stale FROM orders""")
def iso_parse_staleness(t: Tables):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = dates.parse_iso(text)
    return t.orders.select("o_orderkey", parsed.cast("date").alias("day"), dates.is_stale(parsed, F.expr("TIMESTAMP_NTZ '1998-09-01 00:00:00'"), 365).alias("stale"))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts - INTERVAL 1 DAY WHEN 'signup' THEN ts - INTERVAL 1 DAY * (event_id % 9)
       WHEN 'purchase' THEN ts - INTERVAL 30 DAY * (event_id % 9) END AS at,
       CASE event_type WHEN 'view' THEN 'day' WHEN 'click' THEN 'day' WHEN 'signup' THEN 'day' WHEN 'purchase' THEN 'coarse' END AS precision
FROM events""")
def relative_dates(t: Tables):
    n = (F.col("event_id") % 9).cast("string")
    text = (
        F.when(F.col("event_type") == "view", "Posted today").when(F.col("event_type") == "click", "yesterday at noon")
        .when(F.col("event_type") == "signup", F.concat(n, F.lit(" days ago"))).when(F.col("event_type") == "purchase", F.concat(n, F.lit(" Months ago")))
    )
    found = dates.relative_date(text, F.col("ts"))
    return t.events.select("event_id", found["at"].cast("timestamp_ntz").alias("at"), found["precision"].alias("precision"))


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5""")
def bounded_ledger(t: Tables):
    return dedupe.recent_only(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "event_type")


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""")
def status_changes(t: Tables):
    return health.changes(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def seen_ledger_stream(t: Tables):
    """The first event of each user and kind, appended by a stream that reads what has landed, batch by batch; a second run adds nothing."""
    folder = incremental.new_folder(t.spark, "seen")
    shape = t.events.schema
    landed = t.spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(t.folder)
    for _ in range(2):
        incremental.ingest(landed, f"{folder}/store", f"{folder}/checkpoint", "user_id", "event_type", "ts")
    return incremental.read_store(t.spark, f"{folder}/store", shape).select("user_id", "event_type", "event_id")
