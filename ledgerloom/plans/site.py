"""Queries of the site's lists: documents stand for articles, orders for pages, suppliers for sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import health, views
from ledgerloom.registry import Tables, query


@query("""
SELECT doc_id, source FROM documents
WHERE contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), 'the re') AND contains(lower(coalesce(source, '')), 'e')""")
def article_search(t: Tables):
    return views.articles(t.documents, ["source", "text"], " The re", "e", "source").select("doc_id", "source")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'archived' WHEN o_orderkey % 5 <> 0 THEN 'current' END AS lane FROM orders""")
def page_lanes(t: Tables):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "new").alias("update_status"),
        F.when(F.col("o_orderkey") % 5 == 0, True).when(F.col("o_orderkey") % 5 == 1, False).alias("feed_hidden"),
    )
    return rows.select("o_orderkey", views.lane().alias("lane"))


@query("""
SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS FIRST, o_orderkey DESC))::INT AS nth
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS d FROM orders)""")
def newest_pages(t: Tables):
    """A customer's pages newest first; only years are known, so that many tie."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("moment"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*views.newest_first("moment", "o_orderkey")))
    return rows.select("o_orderkey", "o_custkey", nth.alias("nth"))


@query("""
SELECT status, place, count(s_suppkey) AS n FROM (VALUES ('Active', 1), ('Manual watch', 2), ('Needs adapter', 3), ('Disabled', 4), ('Error', 5), ('Unknown', 6)) v(status, place)
LEFT JOIN (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'Error' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'retired' END AS s FROM supplier) ON s = status GROUP BY ALL""")
def source_state_totals(t: Tables):
    turn = F.col("s_suppkey") % 5
    return health.source_totals(t.supplier.select(F.when(turn == 0, "Active").when(turn == 1, "Error").when(turn == 2, "Unknown").when(turn == 3, "retired").alias("status")))


@query("""
SELECT o_orderkey, reaction, replace(lower(reaction), ' ', '-') AS reaction_class, state AS feed_evidence_state,
       CASE WHEN state IN ('pilot_sample', 'static_sample') THEN 'Verified reports' WHEN state = 'official_only' THEN 'Official source only' WHEN state = 'consensus_live' THEN 'Live consensus'
            WHEN state = 'insufficient_data' THEN 'Insufficient data' ELSE upper(label[1]) || lower(label[2:]) END AS feed_evidence_label
FROM (SELECT *, replace(CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE state END, '_', ' ') AS label FROM (
  SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'Mostly Negative' WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'Insufficient' END AS reaction,
         CASE o_orderkey % 6 WHEN 0 THEN 'pilot_sample' WHEN 1 THEN 'official_only' WHEN 2 THEN 'consensus_live' WHEN 3 THEN 'under_review' WHEN 4 THEN 'static_sample' ELSE 'insufficient_data' END AS state
  FROM orders))""")
def shown_fields(t: Tables):
    """What cards show of pages, with missing and empty fields."""
    key = F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, ("Pilot-Sample", "official_only", "CONSENSUS-live", "Under-REVIEW", "static_sample", ""))), (key % 6).cast("int"))
    rows = t.orders.select(
        "o_orderkey", F.when(key % 3 == 0, "Mostly Negative").when(key % 3 == 1, "").alias("update_consensus_label"), F.when(key % 5 == 0, F.col("o_orderpriority")).alias("community_reaction"),
        state.alias("evidence_state"), F.when(key % 4 == 1, F.col("o_orderpriority")).when(key % 4 == 2, "").alias("evidence_state_label"),
    )
    return rows.select("o_orderkey", *[c.alias(name) for name, c in views.shown_fields().items()])
