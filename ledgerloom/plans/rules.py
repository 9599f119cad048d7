"""Rule and ordering queries: predicates, resolvers, table orders and text forms over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, text, versions
from ledgerloom.operators import dedupe, gates, health, records, temporal, views
from ledgerloom.registry import Tables, query
from ledgerloom.sources import captures, feeds, landed, pages, release_pages


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN tb = '' AND tk = '' THEN 'windows_record_missing_target_identity' WHEN b = '' AND k = '' THEN 'missing_kb_or_build'
       WHEN NOT ok AND k <> '' AND k = tk AND f <> '' AND f <> tf THEN 'wrong_feature_train_for_kb' WHEN NOT ok THEN 'stale_due_to_patch_rollover'
       WHEN l_shipdate::DATE < DATE '1995-06-01' THEN 'source_date_before_target_release_date' END AS reason
FROM (SELECT *, (tb <> '' AND b = tb) OR (tk <> '' AND k = tk AND f = tf) AS ok FROM (
  SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'b' || l_suppkey % 3 END AS tb, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'k' || l_suppkey % 2 END AS tk, '24H2' AS tf,
         CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'b' || l_partkey % 3 END AS b, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'k' || l_partkey % 2 END AS k, CASE WHEN l_linenumber % 2 = 0 THEN '24H2' ELSE '25H2' END AS f FROM lineitem))""")
def windows_identity(t: Tables):
    name = lambda letter, c, n, blank: F.when(F.col(c) % blank == 0, F.lit(None)).otherwise(F.concat(F.lit(letter), F.col(c) % n))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", name("b", "l_suppkey", 3, 9).alias("target_os_build"), name("k", "l_suppkey", 2, 9).alias("target_kb"), F.lit("").alias("target_feature_version"), F.lit("24H2").alias("update_version"),
        name("b", "l_partkey", 3, 5).alias("matched_os_build"), name("k", "l_partkey", 2, 4).alias("matched_kb"), F.when(F.col("l_linenumber") % 2 == 0, "24H2").otherwise("25H2").alias("matched_feature_version"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("source_date"), F.lit("1995-06-01").alias("target_release_date"),
    )
    return rows.select("l_orderkey", "l_linenumber", gates.first_failure(gates.windows_identity()).alias("reason"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_quantity > 25 OR l_suppkey % 2 = 0) THEN 'not_patch_specific' WHEN l_tax = 0.08 THEN 'counted_false' WHEN l_returnflag = 'R' THEN 'invalid_sentiment' END AS reason FROM lineitem""")
def lenient_inclusion(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, True).alias("patch_version_matched"), F.lit("Update 7.1b").alias("update_version"), F.lit(None).cast("string").alias("parent_title"),
        F.when(F.col("l_suppkey") % 2 == 0, "the update 7.1B broke it").alias("report_title"), F.lit("").alias("report_text_excerpt"), F.when(F.col("l_tax") == 0.08, False).alias("counted"),
        F.when(F.col("l_returnflag") == "A", " Negative").when(F.col("l_returnflag") == "N", "positive").otherwise("angry").alias("sentiment"),
    )
    return rows.select("l_orderkey", "l_linenumber", gates.first_failure(records.lenient_inclusion()).alias("reason"))


@query("""
SELECT event_id, concat_ws(', ', CASE WHEN user_id % 7 = 0 THEN 'missing source_url' END, CASE WHEN event_type = 'login' THEN 'missing capture_status' END,
       CASE WHEN event_type IN ('login', 'refund') THEN 'unknown status' END, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'error without reason' END) AS problems FROM events""")
def capture_problems(t: Tables):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "refund", "refund").when(F.col("event_type") != "login", "success")
    rows = t.events.select(
        "event_id", F.when(F.col("user_id") % 7 == 0, " ").otherwise("https://a").alias("source_url"), F.lit("s").alias("source_name"), F.lit("t").alias("captured_at"), F.lit("m").alias("capture_method"),
        status.alias("capture_status"), F.when(F.col("user_id") % 2 == 1, "r").alias("error_reason"),
    )
    return captures.problems(rows).select("event_id", F.array_join("problems", ", ").alias("problems"))


@query("""
SELECT o_orderkey, c AS window_channel, s AS window_start FROM orders LEFT JOIN (
  SELECT p_size AS v, p_brand AS c, p_partkey AS s FROM part WHERE p_partkey % 3 <> 0) w ON o_custkey % 60 = v
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN c = 'Brand#' || (o_orderkey % 5 + 1) || '1' THEN 0 ELSE 1 END, s) = 1""")
def window_fallback(t: Tables):
    mentions = t.orders.select("o_orderkey", F.lit("p").alias("product"), (F.col("o_custkey") % 60).cast("int").alias("version"), F.concat(F.lit("Brand#"), F.col("o_orderkey") % 5 + 1, F.lit("1")).alias("channel"))
    windows = t.part.where("p_partkey % 3 <> 0").select(F.lit("p").alias("product"), F.col("p_size").alias("version"), F.col("p_brand").alias("channel"), F.col("p_partkey").alias("window_start"))
    return temporal.window_for_version(mentions, windows, "product", "version", "channel").select("o_orderkey", "window_channel", "window_start")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def rejected_only(t: Tables):
    rejected, accepted = t.lineitem.where("l_returnflag = 'R'"), t.lineitem.where("l_returnflag <> 'R'")
    return dedupe.not_accepted_elsewhere(rejected, accepted, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""
SELECT s_suppkey, concat_ws(', ', CASE WHEN s_suppkey % 5 = 0 THEN 'missing method_id' END, CASE WHEN s_suppkey % 4 = 1 THEN 'unknown status' END, CASE WHEN s_suppkey % 3 = 2 THEN 'bad last_run' END, CASE WHEN s_acctbal < 0 THEN 'negative candidates_found' END) AS errors
FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 4 = 1 OR s_suppkey % 3 = 2 OR s_acctbal < 0""")
def method_validation(t: Tables):
    rows = t.supplier.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, "m").alias("method_id"), F.when(F.col("s_suppkey") % 4 == 1, "odd").otherwise("success").alias("status"),
        F.when(F.col("s_suppkey") % 3 == 2, "soon").when(F.col("s_suppkey") % 3 == 1, "2026-01-01").alias("last_run"), F.floor("s_acctbal").alias("candidates_found"),
    )
    found = health.validation_errors(rows, ("method_id",), ("candidates_found",), buckets.METHOD_STATUSES, "last_run")
    return found.select("s_suppkey", F.array_join("errors", ", ").alias("errors"))


@query(r"""
SELECT page_id, nth::INT AS nth, title, length(piece)::BIGINT AS n FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(piece, '(?is)^<h[12]\b[^>]*>(.*?)</h[12]>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title, piece, nth FROM (
    SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS nth FROM (SELECT page_id, string_split(regexp_replace(html, '(?is)(<h[12]\b[^>]*>.*?</h[12]>)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM pages)))
WHERE title <> ''""")
def page_sections(t: Tables):
    found = release_pages.sections(t.pages, r"<h[12]\b[^>]*>.*?</h[12]>")
    return found.select("page_id", "nth", "title", F.length("section").cast("long").alias("n"))


@query(r"""
SELECT page_id, line_no, title FROM (
  SELECT page_id, line_no - 1 AS line_no, line AS title FROM (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no FROM (
    SELECT page_id, ['Bug ' || page_id, 'a', 'b', 'c', 'bug early', 'd', 'e', 'f', 'Bug late', 'g', 'h', 'i', 'j', 'k', 'l', 'BUG ' || page_id, 'm'] AS ls FROM pages)))
WHERE line_no IN (0, 8)""")
def listing_cards(t: Tables):
    lines = F.array_join(
        F.array(*[F.concat(F.lit(x[:-1]), F.col("page_id").cast("string")) if x.endswith("#") else F.lit(x) for x in ("Bug #", "a", " ", "b", "c", "bug early", "d", "e", "f", "Bug late", "g", "h", "i", "j", "k", "l", "BUG #", "m")]), "\n"
    )
    return records.listing_cards(t.pages.select("page_id", lines.alias("text")), lambda line: line.lower().startswith("bug")).select("page_id", "line_no", "title")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate DESC NULLS LAST, lpad(o_orderkey::VARCHAR, 12, '0')) AS place FROM orders""")
def table_order(t: Tables):
    """Places in each customer's table."""
    rows = t.orders.withColumn("version", F.col("o_orderkey").cast("string"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*views.table_order(F.col("o_orderpriority"), "o_orderdate", "version", descending=True)))
    return rows.select("o_orderkey", place.alias("place"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END, c_custkey) AS place FROM customer")
def selected_first(t: Tables):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*views.selected_order("c_mktsegment", "MACHINERY", "c_custkey")))
    return t.customer.select("c_custkey", place.alias("place"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || '.2.1' WHEN p_size % 3 = 1 THEN '10.' || p_size ELSE NULL END AS version, CASE p_size % 3 WHEN 2 THEN 'beta' ELSE 'stable' END AS channel,
       p_size % 3 = 0 AND p_size < 30 AS known, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, p_brand) AS first_name FROM part""")
def version_forms(t: Tables):
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("from 9.1 to "), "p_size", F.lit(".2.1, not 3.4"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("v1.2 or 10."), "p_size")).otherwise("the public beta")
    status = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") < 30, " No_Results ").otherwise("odd")).otherwise("odd")
    return t.part.select(
        "p_partkey", versions.most_specific(said).alias("version"), versions.channel(said).alias("channel"), (buckets.known_status(status) != "broken").alias("known"),
        text.first_known(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_brand")).alias("first_name"),
    )


@query("""
SELECT p_partkey, 'https://a/x?token=REDACTED&id=' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_name || ', new' || ', and ' || p_brand ELSE p_name || ' and ' || p_brand END AS listed,
       CASE WHEN p_size <= 10 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][p_size + 1] ELSE p_size::VARCHAR END AS word,
       CASE p_size % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'timeout' WHEN 2 THEN '' ELSE 'fetch_error' END AS error, 'Premiere ' || p_size || '.1, ' || p_size || '.1.0, Premiere ' || p_size || '.1.0' AS aliases,
       CASE WHEN p_size % 2 = 0 THEN DATE '1995-01-05' END AS on_day FROM part""")
def text_forms(t: Tables):
    items = F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "new").otherwise(""), F.col("p_brand"))
    version = F.concat(F.col("p_size"), F.lit(""))
    error = F.when(F.col("p_size") % 4 == 0, "HTTP 429").when(F.col("p_size") % 4 == 1, "read timed out").when(F.col("p_size") % 4 == 2, " ").otherwise("odd")
    names = F.array_join(versions.aliases(F.concat(version, F.lit(".1")), ("Premiere",)), ", ")
    day = pages.month_date(F.when(F.col("p_size") % 2 == 0, "posted January 5, 1995 at noon").otherwise("January 45, 1995"))
    return t.part.select(
        "p_partkey", text.scrub_secrets(F.concat(F.lit("https://a/x?token=s3cr3t&id="), "p_partkey")).alias("url"), text.prose_list(items).alias("listed"), text.number_word(F.col("p_size")).alias("word"),
        buckets.error_class(error).alias("error"), names.alias("aliases"), day.alias("on_day"),
    )


@query("""
SELECT event_id, date_trunc('second', ts) AS at, ts::DATE - 45 AS since, user_id % 3 <> 0 OR ts >= TIMESTAMP '2024-01-02' AS kept FROM events""")
def feed_dates(t: Tables):
    mail = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = t.events.select("event_id", "ts", F.when(F.col("user_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("source_date"))
    kept = landed.since(rows, "2024-01-02").select("event_id", F.lit(True).alias("k"))
    return t.events.join(kept, "event_id", "left").select("event_id", feeds.published(mail).cast("timestamp_ntz").alias("at"), dates.since(F.col("ts"), 45).alias("since"), F.coalesce("k", F.lit(False)).alias("kept"))
