"""Evidence queries: line items stand for reports (part: product version, return flag: sentiment), orders for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import buckets
from ledgerloom.operators import consensus, dedupe, gates, reconcile
from ledgerloom.registry import Tables, query

SENTIMENT = "CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'positive' ELSE 'moderate' END"
#: Severity by quantity, bucket by ship month: stand-ins for report fields.
SEVERITY = "CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END"
TIER = "CASE WHEN {n} >= 33 THEN 'High' WHEN {n} >= 25 THEN 'Medium' WHEN {n} >= 8 THEN 'Low-Medium' WHEN {n} > 0 THEN 'Low' ELSE 'Insufficient' END"
LABEL = """CASE WHEN {n} <= 0 THEN 'Insufficient data' WHEN {neg} / {n}::DOUBLE >= 0.55 THEN 'Negative'
WHEN {pos} / {n}::DOUBLE >= 0.55 AND {neg} = 0 THEN 'Positive' ELSE 'Moderate' END"""


def reports(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("product_id"), F.expr(SENTIMENT).alias("sentiment"), F.expr(SEVERITY).alias("severity"),
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_discount",
    )


@query(f"""
SELECT l_partkey AS product_id, count(*) AS report_count, count(*) FILTER ({SENTIMENT} = 'positive') AS positive,
       count(*) FILTER ({SENTIMENT} = 'moderate') AS moderate, count(*) FILTER ({SENTIMENT} = 'negative') AS negative,
       {LABEL.format(n="count(*)", neg="count(*) FILTER (l_returnflag = 'A')", pos="count(*) FILTER (l_returnflag = 'N')")} AS label,
       {TIER.format(n="count(*)")} AS confidence
FROM lineitem GROUP BY l_partkey""")
def consensus_label(t: Tables):
    return consensus.verdicts(reports(t), ("product_id",))


@query(f"SELECT l_linestatus AS line_status, {SEVERITY} AS severity, count(*) AS n FROM lineitem GROUP BY ALL")
def severity_histogram(t: Tables):
    return reports(t).groupBy(F.col("l_linestatus").alias("line_status"), buckets.severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


GATE_CASE = """CASE WHEN l_quantity < 5 THEN 'missing_exact_patch_version_match' WHEN l_discount = 0 THEN 'source_url_not_specific_report'
WHEN o_orderdate IS NOT NULL AND l_shipdate::DATE < o_orderdate::DATE THEN 'source_date_before_or_unverified_against_release'
WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'not_a_real_issue_report' END"""


def gated_lines(t: Tables):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    passes = F.when(F.col("o_orderdate").isNotNull(), F.col("l_shipdate").cast("date") >= F.col("o_orderdate").cast("date"))
    return gates.gated(
        rows,
        [
            ("missing_exact_patch_version_match", F.col("l_quantity") < 5),
            ("source_url_not_specific_report", F.col("l_discount") == 0),
            ("source_date_before_or_unverified_against_release", passes.eqNullSafe(F.lit(False))),
            ("not_a_real_issue_report", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
        ],
    )


@query(f"""
SELECT l_orderkey, l_linenumber, {GATE_CASE} AS exclusion_reason, {GATE_CASE} IS NULL AS counted
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def first_failure_gate(t: Tables):
    return gated_lines(t).select("l_orderkey", "l_linenumber", "exclusion_reason", "counted")


@query(f"""
SELECT coalesce({GATE_CASE}, 'included') AS reason, count(*) AS n
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def include_exclude_counts(t: Tables):
    return gates.reason_histogram(gated_lines(t))


@query("""
SELECT string_agg(reason || '=' || n, ', ' ORDER BY reason) AS rejected FROM (
  SELECT CASE WHEN l_quantity < 5 THEN 'low' WHEN l_discount = 0 THEN 'plain' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL)
WHERE reason IS NOT NULL""")
def rejection_summary(t: Tables):
    reason = gates.first_failure([("low", F.col("l_quantity") < 5), ("plain", F.col("l_discount") == 0)])
    counts = t.lineitem.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where("reason IS NOT NULL")
    return counts.agg(F.expr("listagg(concat(reason, '=', n), ', ') WITHIN GROUP (ORDER BY reason)").alias("rejected"))


FLAGS = "CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_quantity > 10 END AS counted, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount > 0.02 END AS matched"


@query(f"""
SELECT l_partkey AS product_id, count(*) FILTER (counted IS DISTINCT FROM false AND matched IS NOT DISTINCT FROM true) AS authoritative,
       count(*) FILTER (counted IS DISTINCT FROM false) AS lenient, count(*) FILTER (counted IS NOT DISTINCT FROM true) AS strict
FROM (SELECT l_partkey, {FLAGS} FROM lineitem) GROUP BY l_partkey""")
def authoritative_counts(t: Tables):
    counted = F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(F.col("l_quantity") > 10)
    matched = F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_discount") > 0.02)
    rows = t.lineitem.select("l_partkey", counted.alias("counted"), matched.alias("matched"))
    return rows.groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.count_if(gates.authoritative(F.col("counted"), F.col("matched"))).alias("authoritative"),
        F.count_if(~F.col("counted").eqNullSafe(F.lit(False))).alias("lenient"),
        F.count_if(F.col("counted").eqNullSafe(F.lit(True))).alias("strict"),
    )


@query("""
SELECT o_orderkey AS product_id, floor(o_totalprice / 50000)::BIGINT AS update_report_count, coalesce(n, 0) AS n_counted,
       CASE WHEN coalesce(n, 0) <= 0 THEN 'official_only' ELSE 'pilot_sample' END AS evidence_state,
       CASE WHEN coalesce(n, 0) <= 0 THEN 'deferred_official_only' ELSE 'pilot_initial_sample' END AS collection_status,
       floor(o_totalprice / 50000)::BIGINT <> coalesce(n, 0) AS changed
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10 GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def reconcile_counts(t: Tables):
    evidence = t.lineitem.select(F.col("l_orderkey").alias("product_id"), (F.col("l_quantity") > 10).alias("counted"), (F.col("l_returnflag") == "A").alias("patch_version_matched"))
    records = t.orders.select(F.col("o_orderkey").alias("product_id"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("update_report_count"))
    return reconcile.reconcile(records, reconcile.counted(evidence, ("product_id",)), ("product_id",))


@query("""
SELECT coalesce(c_custkey, o_custkey) AS custkey, shown, actual,
       CASE WHEN o_custkey IS NULL THEN 'record_without_evidence' WHEN c_custkey IS NULL THEN 'evidence_without_record'
            WHEN shown IS DISTINCT FROM actual THEN 'count_mismatch' ELSE 'aligned' END AS finding
FROM (SELECT c_custkey, (c_custkey % 20)::BIGINT AS shown FROM customer WHERE c_acctbal >= 0) c
FULL JOIN (SELECT o_custkey, count(*) AS actual FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def audit_full_outer(t: Tables):
    shown = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("custkey"), (F.col("c_custkey") % 20).cast("long").alias("shown"))
    actual = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("actual"))
    return reconcile.full_audit(shown, actual, ("custkey",), "shown", "actual")


@query("""
WITH c AS (SELECT c_custkey, (c_custkey % 20)::BIGINT AS shown FROM customer WHERE c_acctbal >= 0),
o AS (SELECT o_custkey, count(*) AS actual FROM orders GROUP BY o_custkey)
SELECT CASE WHEN o_custkey IS NULL THEN 'record_without_evidence' WHEN c_custkey IS NULL THEN 'evidence_without_record'
            WHEN shown IS DISTINCT FROM actual THEN 'count_mismatch' ELSE 'aligned' END AS finding, count(*) AS n
FROM c FULL JOIN o ON c_custkey = o_custkey GROUP BY ALL""")
def audit_categories(t: Tables):
    return audit_full_outer(t).groupBy("finding").agg(F.count("*").alias("n"))


@query(f"""
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS arrival, l_linestatus || l_returnflag AS bucket,
                  CASE {SEVERITY} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sev FROM lineitem),
h AS (SELECT l_partkey, bucket, count(*) AS n, min(arrival) AS seen FROM r GROUP BY l_partkey, bucket),
b AS (SELECT l_partkey, bucket, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, seen) AS bucket_rank FROM h),
n AS (SELECT r.*, bucket_rank, row_number() OVER (PARTITION BY r.l_partkey, r.bucket ORDER BY sev DESC, arrival) AS nth FROM r JOIN b USING (l_partkey, bucket)),
p AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN nth = 1 THEN bucket_rank END NULLS LAST, sev DESC, arrival) AS place FROM n)
SELECT l_partkey AS product_id, place::INT AS place, l_orderkey, l_linenumber, bucket FROM p WHERE place <= 5""")
def representatives(t: Tables):
    rows = reports(t).withColumn("arrival", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("bucket", F.concat("l_linestatus", "l_returnflag"))
    found = consensus.representatives(rows, ("product_id",), "bucket", buckets.severity_rank(F.col("severity")), "arrival")
    return found.select("product_id", "place", "l_orderkey", "l_linenumber", "bucket")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def ambiguous_identity(t: Tables):
    return consensus.ambiguous(t.part, ("p_brand", "p_size"))


@query("""
SELECT p_name AS product, l_suppkey AS supplier, l_orderkey, l_linenumber, first_value(l_suppkey) OVER w AS owned_by,
       first_value(l_suppkey) OVER w <> l_suppkey AS is_duplicate
FROM lineitem JOIN part ON l_partkey = p_partkey WINDOW w AS (PARTITION BY p_name ORDER BY l_orderkey, l_linenumber)""")
def cross_version_excl(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("product"), F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber"
    )
    return dedupe.exclusive_owner(rows, "product", [F.col("l_orderkey"), F.col("l_linenumber")], "supplier")


@query("""
SELECT coalesce(a.k, b.k) AS user_id, coalesce(a.t, b.t) AS event_type, coalesce(b.v, a.v) AS event_value,
       CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL OR a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'replaced' END AS change
FROM (SELECT user_id AS k, event_type AS t, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL) a
FULL JOIN (SELECT user_id AS k, event_type AS t, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL) b ON a.k = b.k AND a.t = b.t""")
def emh_upsert(t: Tables):
    half = lambda odd: t.events.where(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg(F.max("value").alias("event_value"))
    return dedupe.upsert(half(0), half(1), ["user_id", "event_type"], ["event_value"])


@query("""
SELECT user_id, event_type, count(*) FILTER (value >= 50) AS accepted, count(*) AS candidates,
       CASE WHEN count(*) FILTER (value >= 50) > 0 AND event_type = 'error' THEN 'partial' WHEN count(*) FILTER (value >= 50) > 0 THEN 'success'
            WHEN event_type = 'error' THEN 'broken' WHEN count(*) > 0 THEN 'manual_review_needed' ELSE 'no_results' END AS status
FROM events GROUP BY user_id, event_type""")
def method_health_status(t: Tables):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 50).alias("accepted"), F.count("*").alias("candidates"))
    errors = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return counts.withColumn("status", buckets.method_status(F.col("accepted"), F.col("candidates"), errors))


@query("""
SELECT p_partkey, p_brand, concat_ws('; ', CASE WHEN NOT p_size >= 5 THEN 'gate_01_size' END, CASE WHEN NOT p_retailprice >= 950 THEN 'gate_02_price' END,
       CASE WHEN NOT p_type NOT LIKE '%BRASS%' THEN 'gate_03_type' END) AS failures
FROM part""")
def gate_evaluation(t: Tables):
    rules = {"gate_01_size": F.col("p_size") >= 5, "gate_02_price": F.col("p_retailprice") >= 950, "gate_03_type": ~F.contains("p_type", F.lit("BRASS"))}
    return t.part.select("p_partkey", "p_brand", consensus.gate_failures(rules).alias("failures"))


@query(f"""
WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS neg, count(*) FILTER (l_returnflag = 'N') AS pos FROM lineitem GROUP BY l_partkey),
v AS (SELECT *, {LABEL.format(n="n", neg="neg", pos="pos")} AS label FROM c)
SELECT l_partkey AS product_id, label, CASE WHEN n <= 0 THEN 'INSUFFICIENT DATA' WHEN l_partkey % 7 = 0 AND label = 'Negative' THEN 'AVOID for production'
       WHEN label = 'Negative' THEN 'WAIT' WHEN label = 'Positive' THEN 'SAFE ENOUGH to test' ELSE 'TEST FIRST' END AS recommendation,
       label || ' consensus from ' || n || ' patch-specific ' || CASE WHEN n = 1 THEN 'report' ELSE 'reports' END || '.' AS summary
FROM v""")
def recommendations(t: Tables):
    found = consensus_label(t)
    return found.select(
        "product_id", "label", buckets.recommendation(F.col("label"), F.col("report_count"), F.col("product_id") % 7 == 0).alias("recommendation"),
        consensus.summary_sentence(F.col("label"), F.col("report_count"), F.lit("")).alias("summary"),
    )


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0),
a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.s IS DISTINCT FROM b.s""")
def before_after_diff(t: Tables):
    before = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    after = t.orders.where("o_orderkey % 3 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return reconcile.changed_rows(before, after, ("o_orderkey",), ("s",)).select("o_orderkey", "change")
