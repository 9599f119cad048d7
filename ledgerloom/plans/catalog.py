"""Catalog and run queries: payload totals, histograms, roll-ups, enrichment, coverage, refreshing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import consensus, dedupe, health, publication, records, temporal, views
from ledgerloom.registry import Tables, query
from ledgerloom.sources import release_pages


@query("""
WITH g AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS excluded FROM lineitem GROUP BY l_partkey)
SELECT count(*) AS groups, sum(n)::BIGINT AS rows_seen, sum(n - excluded)::BIGINT AS included, sum(excluded)::BIGINT AS excluded,
       count(*) FILTER (n - excluded = 0) AS empty_groups FROM g""")
def run_payload_totals(t: Tables):
    rows = t.lineitem.select("l_partkey", (F.col("l_discount") <= 0.05).alias("included"))
    return publication.payload_totals(rows, ["l_partkey"], F.col("included"))


@query("""
SELECT s AS event_type, coalesce(n, 0) AS n FROM (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error'), ('refund'), ('login')) a(s)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON s = event_type""")
def method_totals(t: Tables):
    return health.status_totals(t.events, "event_type", ("view", "click", "signup", "purchase", "error", "refund", "login"))


@query("""
SELECT l_partkey AS product_id, count(*) FILTER (l_linestatus = 'O') AS active, count(*) FILTER (l_linestatus = 'F') AS resolved,
       count(*) FILTER (l_linestatus = 'O' AND l_quantity > 45) AS safeguards, bool_or(l_linestatus = 'O') AS known_issues_present
FROM lineitem GROUP BY l_partkey""")
def product_issue_rollup(t: Tables):
    state = F.when(F.col("l_linestatus") == "O", "active").otherwise("resolved")
    hold = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "1").otherwise("")
    issues = t.lineitem.select(F.col("l_partkey").alias("product_id"), state.alias("state"), hold.alias("safeguard_id"))
    return release_pages.issue_counts(issues, ["product_id"]).withColumn("known_issues_present", F.col("active") > 0).drop("n")


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'decision' WHEN grouping(o_orderpriority) = 0 THEN 'source_type' ELSE 'total' END AS histogram,
       coalesce(o_orderstatus, o_orderpriority, '') AS value, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def candidate_histograms(t: Tables):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    counted = t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.grouping("o_orderstatus").alias("g1"), F.grouping("o_orderpriority").alias("g2")
    )
    name = F.when(F.col("g1") == 0, "decision").when(F.col("g2") == 0, "source_type").otherwise("total")
    return counted.select(name.alias("histogram"), F.coalesce("o_orderstatus", "o_orderpriority", F.lit("")).alias("value"), "n")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, n_name, r_name) AS logo, n_name AS company, r_name AS category
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def card_enrichment(t: Tables):
    key = F.col("c_custkey").cast("string")
    cards = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, key).alias("url"), F.upper("c_name").alias("product_name"))
    pages = t.customer.where("c_custkey % 2 = 0").select(key.alias("url"), key.alias("product_id"))
    products = t.customer.select(key.alias("product_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("company_id"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("logo"))
    companies = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    companies = companies.select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company"), F.col("r_name").alias("category"), F.coalesce("n_name", "r_name").alias("logo"))
    return publication.card_enrichment(cards, pages, products, companies).select("c_custkey", "logo", "company", "category")


@query("""
SELECT segment, count(c_custkey) AS products, CASE WHEN count(c_custkey) = 0 THEN 'missing' ELSE 'covered' END AS coverage
FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SPACE'), ('AUTOMOBILE')) a(segment) LEFT JOIN customer ON c_mktsegment = segment GROUP BY segment""")
def priority_coverage(t: Tables):
    wanted = t.spark.createDataFrame([(s,) for s in ("BUILDING", "MACHINERY", "SPACE", "AUTOMOBILE")], "segment string")
    have = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("products"))
    n = F.coalesce("products", F.lit(0))
    return wanted.join(have, "segment", "left").select("segment", n.alias("products"), F.when(n == 0, "missing").otherwise("covered").alias("coverage"))


@query("SELECT p_name || ' ' || p_size AS build, min(p_brand) AS kb FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) = 1")
def unique_build_map(t: Tables):
    return dedupe.unique_pairs(t.part.select(F.concat_ws(" ", "p_name", "p_size").alias("build"), F.col("p_brand").alias("kb")), "build", "kb")


@query("""
SELECT conv_id, turn, string_agg(role, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS context FROM conversations""")
def context_lines(t: Tables):
    return temporal.context_lines(t.conversations, "conv_id", "turn", "role", 2, 1).select("conv_id", "turn", "context")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus AS body FROM orders WHERE o_orderkey % 3 <> 0),
i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderstatus END AS body, o_orderkey % 2 AS odd FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(s.o_orderkey, i.o_orderkey)::VARCHAR AS update_version,
       CASE WHEN s.o_orderkey IS NULL THEN 'created' WHEN i.o_orderkey IS NULL THEN 'unchanged' WHEN i.body <> '' AND i.body <> s.body THEN 'refreshed'
            WHEN odd = 1 THEN 'freshness-updated' ELSE 'unchanged' END AS action
FROM s FULL JOIN i ON s.o_orderkey = i.o_orderkey""")
def refresh_actions(t: Tables):
    base = t.orders.select(F.col("o_custkey").cast("string").alias("product_id"), F.col("o_orderkey").cast("string").alias("update_version"), "o_orderkey", "o_orderstatus", F.lit("u").alias("url"), F.lit(None).cast("int").alias("issues"))
    stored = base.where("o_orderkey % 3 <> 0").withColumns({"body": F.col("o_orderstatus"), "source_last_checked": F.lit("t0"), "official_source_attempts": F.array(F.lit("t0"))})
    body = F.when(F.col("o_orderkey") % 4 == 0, "X").when(F.col("o_orderkey") % 4 == 1, "").otherwise(F.col("o_orderstatus"))
    checked = F.when(F.col("o_orderkey") % 2 == 1, "t1").otherwise("t0")
    incoming = base.where("o_orderkey % 3 <> 1").withColumns({"body": body, "source_last_checked": checked})
    return records.refresh_records(stored, incoming, ["url"], ["body"], ["issues"]).select("update_version", "action")


@query("""
SELECT class, coalesce(n, 0) AS n FROM (VALUES ('malformed_row'), ('missing_url'), ('candidate_for_revalidation'), ('pending_source_adapter'), ('unsupported_source_type')) a(class)
LEFT JOIN (SELECT CASE WHEN source IS NULL OR lang = 'de' THEN 'malformed_row' WHEN n_chars < 300 THEN 'missing_url' WHEN source IN ('src0', 'src1') THEN 'candidate_for_revalidation'
                       WHEN source = 'src2' THEN 'pending_source_adapter' ELSE 'unsupported_source_type' END AS c, count(*) AS n FROM documents GROUP BY c) ON class = c""")
def revalidation_totals(t: Tables):
    rows = t.documents.select(
        F.col("source").alias("source_type"), (F.col("lang") != "de").alias("patch_version_matched"), F.when(F.col("n_chars") >= 300, F.lit("https://a/1")).alias("source_url")
    )
    classes = ("malformed_row", "missing_url", "candidate_for_revalidation", "pending_source_adapter", "unsupported_source_type")
    return records.class_totals(rows, records.revalidation_class(("source_type",), ("src0", "src1"), ("src2",)), classes)


@query("""
SELECT o_custkey AS product_id, count(*) AS methods, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS failed,
       CASE WHEN count(*) = sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) THEN 'failed' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'success' END AS outcome
FROM orders GROUP BY o_custkey""")
def run_outcomes(t: Tables):
    return publication.method_outcomes(t.orders.select(F.col("o_custkey").alias("product_id"), F.col("o_orderstatus")), ["product_id"], F.col("o_orderstatus") == "P")


@query("""
SELECT p_partkey, field, term FROM (
  SELECT p_partkey, 'p_name' AS field, unnest(['red', 'steel', 'brass']) AS term, p_name AS v FROM part
  UNION ALL SELECT p_partkey, 'p_type', unnest(['red', 'brass']), p_type FROM part)
WHERE contains(lower(v), term)""")
def banned_terms(t: Tables):
    return views.banned_terms(t.part, "p_partkey", ["p_name", "p_type"], ("red", "steel", "brass"), (("p_type", "steel"),))


@query("SELECT o_orderpriority AS source, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS share FROM orders GROUP BY ALL")
def source_limitations(t: Tables):
    return consensus.share(t.orders.withColumnRenamed("o_orderpriority", "source"), ("source",), F.col("o_orderstatus") == "F")
