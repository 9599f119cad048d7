"""Text queries: documents stand for report texts, pages for captured HTML, conversations for threads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, text, urls, versions
from ledgerloom.operators import consensus, dedupe, views
from ledgerloom.registry import Tables, query
from ledgerloom.sources import plain_yaml

THEMES = (("render", ("en%%%", "###")), ("audio", ("pathetic", "scum", "worthless")), ("startup", ("token",)), ("export", ("licensed", "copyright")), ("install", (" | ",)))
THEME_SQL = """CASE WHEN contains(lower(text), 'en%%%') OR contains(lower(text), '###') THEN 'render'
WHEN contains(lower(text), 'pathetic') OR contains(lower(text), 'scum') OR contains(lower(text), 'worthless') THEN 'audio'
WHEN contains(lower(text), 'token') THEN 'startup' WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'copyright') THEN 'export'
WHEN contains(lower(text), ' | ') THEN 'install' ELSE 'general workflow reports' END"""


def themed(t: Tables):
    return t.documents.select("doc_id", "source", buckets.theme(F.col("text"), THEMES, F.lit("general workflow reports")).alias("theme"))


@query(f"""
WITH c AS (SELECT source, {THEME_SQL} AS theme, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL)
SELECT source, theme, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen)::INT AS rank FROM c""")
def theme_topk(t: Tables):
    return consensus.histogram(themed(t), ("source",), "theme", "doc_id").select("source", "theme", "n", "rank")


@query(f"""
WITH c AS (SELECT source, {THEME_SQL} AS theme, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen) AS rank FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS place FROM r WHERE theme <> 'general workflow reports')
SELECT source, string_agg(theme, ', ' ORDER BY place) AS themes FROM p WHERE place <= 3 GROUP BY source""")
def top_theme_phrases(t: Tables):
    return consensus.top_themes(consensus.histogram(themed(t), ("source",), "theme", "doc_id"), ("source",), "theme")


NORMAL = r"trim(regexp_replace(lower(text), '[\t\n\v\f\r ]+', ' ', 'g'))"


def normal_key():
    return F.md5(text.collapse(F.lower("text")))


@query(f"SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5({NORMAL})")
def keep_first_dedupe(t: Tables):
    return dedupe.first_ids(t.documents, normal_key(), "doc_id").select("first_id", "copies")


@query(f"""
SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({NORMAL})) AS first_id FROM documents) WHERE doc_id > first_id""")
def duplicate_first_seen(t: Tables):
    return dedupe.later_copies(t.documents.select("doc_id", "text"), normal_key(), "doc_id").select("doc_id", "first_id")


CANONICAL = r"""regexp_replace(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://[^/]*)', 1))
 || regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '')"""


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def url_canonical(t: Tables):
    return t.pages.select("page_id", urls.canonical_page(F.col("url")).alias("canonical"))


@query(f"""
WITH p AS (SELECT page_id, {CANONICAL} AS key FROM pages),
n AS (SELECT * FROM p WHERE page_id % 2 = 1 AND key NOT IN (SELECT key FROM p WHERE page_id % 2 = 0))
SELECT page_id, key FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""")
def anti_join_new(t: Tables):
    pages = t.pages.select("page_id", urls.canonical_page(F.col("url")).alias("key")).withColumn("id", F.col("page_id"))
    new, stored = pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0")
    return dedupe.append_new(new, stored, ["id"], ["key"], F.lit(False), "page_id").select("page_id", "key")


@query(f"""
WITH p AS (SELECT page_id, url, {CANONICAL} AS key FROM pages)
SELECT page_id, key FROM p WHERE url NOT LIKE '%?%' OR key NOT IN (SELECT key FROM p WHERE url NOT LIKE '%?%')""")
def prefer_detail(t: Tables):
    pages = t.pages.select("page_id", "url", urls.canonical_page(F.col("url")).alias("key"))
    return dedupe.prefer_detail(pages, ["key"], ~F.contains("url", F.lit("?"))).select("page_id", "key")


@query(r"""
SELECT page_id, url LIKE 'http%' AND NOT regexp_matches(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/+$', ''), '/(search|forums|forum)$')
       AND trim(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/') NOT IN ('', 'forum', 'forums') AS specific FROM pages""")
def specific_urls(t: Tables):
    return t.pages.select("page_id", urls.specific_report(F.col("url")).alias("specific"))


@query("""
SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS hits, count(*) FILTER (lang = 'en') / count(*)::DOUBLE AS share FROM documents GROUP BY source""")
def reddit_share(t: Tables):
    return consensus.share(t.documents, ("source",), F.col("lang") == "en")


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '[0-9]+(?:\.[0-9]+)+')) AS n_versions, coalesce(regexp_extract_all(html, '[0-9]+(?:\.[0-9]+)+')[1], '') AS first_version,
       regexp_matches(html, '(?i)(^|[^A-Za-z0-9.])html($|[^A-Za-z0-9.])') AS mentioned FROM pages""")
def version_mentions(t: Tables):
    found = versions.all_mentions(F.col("html"))
    return t.pages.select(
        "page_id", F.size(found).cast("long").alias("n_versions"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_version"),
        versions.mentions(F.col("html"), F.lit("html")).alias("mentioned"),
    )


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment_join(t: Tables):
    """Texts that hold a needle, by equi-joins on a part of the needle, then the exact test."""
    return views.holding(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10) || chr(10), 'g'),
 '<[^>]+>', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""


@query(f"SELECT page_id, md5({STRIP}) AS text_md5, length({STRIP})::BIGINT AS n FROM pages")
def html_strip(t: Tables):
    stripped = text.strip_tags(F.col("html"), entities=False)
    return t.pages.select("page_id", F.md5(stripped).alias("text_md5"), F.length(stripped).cast("long").alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(t: Tables):
    return t.pages.select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 280 THEN s ELSE rtrim(regexp_extract(s || ' ', '(?s)^(.{0,277})\s', 1)) || '...' END AS excerpt FROM c""")
def excerpt(t: Tables):
    return t.documents.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("""
SELECT conv_id, turn, first_value(contains(lower(text), 'th')) OVER (PARTITION BY conv_id ORDER BY turn) AS matched FROM conversations""")
def reply_inheritance(t: Tables):
    over = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.first(F.contains(F.lower("text"), F.lit("th"))).over(over).alias("matched"))


@query("""
SELECT source, count(*) AS reports, count(*) FILTER (quality = 1 AND toxic = 0) AS positive, count(*) FILTER (toxic = 1) AS negative,
       CASE WHEN count(quality) = 0 THEN 'Insufficient data' WHEN count(*) FILTER (toxic = 1) / count(quality)::DOUBLE >= 0.55 THEN 'Negative'
            WHEN count(*) FILTER (quality = 1 AND toxic = 0) / count(quality)::DOUBLE >= 0.55 AND count(*) FILTER (toxic = 1) = 0 THEN 'Positive' ELSE 'Moderate' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def labels_consensus(t: Tables):
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    positive, negative = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count_if(F.col("toxic") == 1)
    counts = rows.groupBy("source").agg(F.count("*").alias("reports"), positive.alias("positive"), negative.alias("negative"), F.count("quality").alias("labelled"))
    return counts.withColumn("label", buckets.consensus_label(F.col("positive"), F.col("negative"), F.col("labelled"))).drop("labelled")


@query("""
SELECT a.p_partkey AS short_key, b.p_partkey AS full_key FROM
 (SELECT p_partkey, string_split(p_name, ' ')[1] AS s FROM part QUALIFY row_number() OVER (PARTITION BY string_split(p_name, ' ')[1] ORDER BY p_partkey) = 1) a
 JOIN part b ON b.p_name = a.s OR starts_with(b.p_name, a.s || ' ')""")
def prefix_version_join(t: Tables):
    """Short to full by equality of the first component: a prefix up to a separator is an equi-join."""
    head = F.element_at(F.split("p_name", " "), 1)
    shorts = dedupe.keep_first(t.part.select("p_partkey", head.alias("s")), [F.col("s")], [F.col("p_partkey")]).withColumnRenamed("p_partkey", "short_key")
    fulls = t.part.select(F.col("p_partkey").alias("full_key"), "p_name", head.alias("s"))
    matched = (F.col("p_name") == F.col("s")) | F.startswith("p_name", F.concat(F.col("s"), F.lit(" ")))
    return shorts.join(fulls, "s").where(matched).select("short_key", "full_key")


@query("""
SELECT p_partkey, item, id, name, size, brand, refused FROM (
  SELECT p_partkey, 1 AS item, p_partkey::VARCHAR AS id, p_name AS name, p_size::VARCHAR AS size, NULL AS brand, NULL AS refused FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT p_partkey, 2, 'it''s', NULL, NULL, p_brand, NULL FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'no plain value' FROM part WHERE p_size % 7 = 0)""")
def plain_yaml_items(t: Tables):
    """Items of YAML texts, one a part, by the reader of the plain subset; texts with a flow list are refused."""
    part = lambda c: F.col(c).cast("string")
    written = F.concat(
        F.lit("title: parts\nevidence:\n  - id: "), part("p_partkey"), F.lit('\n    name: "'), F.col("p_name"), F.lit('"\n    size: '), part("p_size"), F.lit(" # inches\n"),
        F.when(F.col("p_size") % 7 == 0, "    tags: [a, b]\n").otherwise(""), F.lit("  - id: 'it''s'\n\n    brand: "), F.col("p_brand"),
    )
    texts = t.part.select(part("p_partkey").alias("path"), written.alias("text"))
    d = lambda k: F.try_element_at("data", F.lit(k)).alias(k)
    items = plain_yaml.list_items(texts, "evidence").select("path", F.col("item").cast("int").alias("item"), d("id"), d("name"), d("size"), d("brand"), F.lit(None).cast("string").alias("refused"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("item", "int"), ("id", "string"), ("name", "string"), ("size", "string"), ("brand", "string"))]
    found = items.unionByName(plain_yaml.refusals(texts).select("path", *nothing, "refused"))
    return found.withColumn("p_partkey", F.col("path").cast("bigint")).drop("path")
