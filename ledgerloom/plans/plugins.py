"""Queries of page sources: table functions over pages and over status pages made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.registry import Tables, query
from ledgerloom.sources import table_functions


@query(r"""
WITH f AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS said,
         unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)))) AS pos
  FROM pages WHERE url IS NOT NULL),
a AS (
  SELECT page_id, url, pos, trim(regexp_replace(regexp_replace(said, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS label,
         CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^[A-Za-z]+:') || href
              WHEN href LIKE '/%' THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || href
              ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^:/])/[^/]*$', '\1') || '/' || href END AS link
  FROM f WHERE href NOT LIKE '#%' AND href NOT LIKE 'mailto:%')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos))::INT AS nth, link, label FROM (
  SELECT page_id, link, min(pos) AS pos, arg_min(label, pos) AS label FROM a WHERE rtrim(link, '/') <> rtrim(url, '/') GROUP BY page_id, link)""")
def page_link_function(t: Tables):
    """Links of all pages by the table function."""
    table_functions.register(t.spark)
    return t.spark.sql("SELECT page_id, nth, link, label FROM page_links(TABLE({pages}))", pages=t.pages)


@query("""
SELECT l_orderkey, 'Part ' || l_partkey || ' fails' || CASE WHEN l_linenumber = 2 THEN ' safeguard ID: ' || l_suppkey ELSE '' END AS summary,
       CASE WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'active' END AS state,
       CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '26100.' || l_linenumber END AS originating_build,
       CASE WHEN l_returnflag = 'R' THEN 'KB' || (5000000 + l_suppkey) ELSE '' END AS resolving_kb,
       CASE WHEN l_linenumber = 2 THEN l_suppkey || '' ELSE '' END AS safeguard_id
FROM lineitem WHERE l_returnflag <> 'N'""")
def known_issue_function(t: Tables):
    """Known issues of status pages by the table function: a page an order, a row a line item, no status for what is not returned yet."""
    table_functions.register(t.spark)

    def row(x):
        line, number = x["l_linenumber"], lambda c: x[c].cast("string")
        cells = (
            F.concat(F.lit("Part "), number("l_partkey"), F.lit(" <b>fails</b>"), F.when(line == 2, F.concat(F.lit(" safeguard ID: "), number("l_suppkey"))).otherwise("")),
            F.when(line % 3 == 0, "N/A").otherwise(F.concat(F.lit("OS Build 26100."), number("l_linenumber"))),
            F.when(x["l_returnflag"] == "R", F.concat(F.lit("Resolved KB"), (x["l_suppkey"] + 5_000_000).cast("string"))).when(x["l_returnflag"] == "A", "Confirmed").otherwise(""),
        )
        return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))

    head = F.lit("<table><tr><th>Summary</th><th>Originating update</th><th>Status</th></tr>")
    # an order has few lines; they are written after the shuffle, which carries their numbers alone
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("lines")
    pages = t.lineitem.groupBy("l_orderkey").agg(lines)
    pages = pages.select("l_orderkey", F.concat(head, F.array_join(F.transform("lines", row), "\n"), F.lit("</table>")).alias("html"))
    return t.spark.sql(
        "SELECT l_orderkey, summary, state, originating_build, resolving_kb, safeguard_id FROM known_issues(TABLE({pages}))", pages=pages
    )
