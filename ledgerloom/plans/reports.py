"""Product chains over real texts: documents and pages are reports, what they say of versions comes from their own words and a phrase.

The SQL states the rules anew, with its own patterns and word lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import products
from ledgerloom.registry import Tables, query

#: What a report's title and the end of its text say besides the words of its document, in turn.
TITLES = (
    "Crash on 2.0", "2.0 is it safe", "Resolve 2.1 freezes", "DaVinci Resolve 2.0 crash", "fails to build 3.1", "DaVinci Resolve 3.1 public beta crash", "1.0", "release notes 1.0",
    "DaVinci 2.0", "nothing to see", "2.00 crash", "Resolve 1.0 workflow",
)
ENDINGS = ("", "It has no audio while recording.", "cmake error", "Resolve 3.1 was fine.", "### Operating System Info", "the export hangs", "on 2.0.", "(2.0.1 too)", "version 9.5", "what's new in 2.1", "It is slow.")
_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

_TEXTS = f"""
WITH doc AS (
  SELECT doc_id AS n, text FROM documents UNION ALL SELECT 1000000000 + page_id, html FROM pages),
r AS (
  SELECT n, {_LIST(TITLES)}[(n % 12)::INT + 1] AS title, coalesce(text, '') || ' ' || {_LIST(ENDINGS)}[(n % 11)::INT + 1] AS body,
         CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN DATE '2024-01-10' ELSE DATE '2024-03-01' END AS dated FROM doc),
rec AS (
  SELECT DISTINCT (p_size % 3 + 1)::INT AS major, (p_size % 3 + 1) || '.' || (p_partkey % 2) AS v FROM part),
c AS (
  SELECT r.*, v, major, title || ' ' || body AS said FROM (
    SELECT *, unnest(list_distinct(regexp_extract_all(title || ' ' || body, '[0-9]+(?:\\.[0-9]+)+'))) AS v FROM r) r JOIN rec USING (v))"""

OBS_SQL = (
    _TEXTS + r""",
o AS (
  SELECT *, regexp_matches(title || chr(10) || body, '(^|[^0-9.])' || replace(v, '.', '\.') || '($|[^0-9.])') AS exact,
         lower(title || ' ' || regexp_replace(body,
           '(?i)###\s*(OBS Studio Log URL|OBS Studio Crash Log URL|Other OS|Operating System Info|OBS Studio Version(?: \(Other\))?)', ' ', 'g')) AS report FROM c)
SELECT n, v AS version, CASE
  WHEN NOT exact THEN 'missing_exact_version'
  WHEN regexp_matches(report, 'build failure|build fails|fails to build|fails to configure|configure when|compile|compiler|cmake|enable_plugins|github actions|developer|libobs-metal fails|there is no build log')
   AND NOT regexp_matches(report, 'crashes on quit|crash if|freeze|hang|lag|recording|streaming|audio mixer|web camera|screen capture|black screen|black square|hotkey|pipewire|xcomposite|rescale output|mouse cursor')
  THEN 'developer_or_build_only'
  WHEN NOT regexp_matches(report, '(^|[^\p{L}\p{N}_])(crash|freez(e|ing)|frozen|hang|(black|green|blue) screen|bsod|no (audio|sound|video|display|signal|output)|won''?t (start|launch)|'
    || '(doesn''t|does not|not) start|fails|won''t (open|install|update)|can''t (open|install|update)|cannot (open|install)|failed|(install|installation|update) fail|failing|failure|not working|'
    || '(doesn''t|does not) work|no longer works|(stopped|quit) working|broken|broke|breaks|breaking|regress(ion|ed)|error|glitch|artifact|stutter|dropped frame|drop frames|frame drop|skipped frames|'
    || 'corrupt|data loss|lag|slowdown|slow to|(very|extremely) slow|memory leak|high cpu|cpu usage|100% cpu|gpu usage|overheat|incompatible|not compatible|compatibility issue|vulnerability|exploit|'
    || 'security (issue|flaw))') THEN 'generic_or_no_concrete_issue'
  WHEN dated IS NULL THEN 'missing_source_date' WHEN dated < DATE '2024-02-01' THEN 'before_release_date' END AS reason
FROM o"""
)
RESOLVE_SQL = (
    _TEXTS + r""",
w AS (SELECT *, lower(said) AS low, regexp_extract_all(said, '(?i)\b(?:davinci\s+resolve(?:\s+studio)?|resolve(?:\s+studio)?|davinci|version)\s+v?(\d{1,2})(?:\.\d+){0,2}\b', 1) AS majors FROM c)
SELECT n, v AS version, CASE
  WHEN NOT regexp_matches(said, '(^|[^A-Za-z0-9.])' || replace(v, '.', '\.') || '($|[^A-Za-z0-9.])') THEN 'missing_exact_patch_version_match'
  WHEN n % 7 = 0 THEN 'source_url_not_specific_report'
  WHEN dated IS NULL OR dated < DATE '2024-02-01' THEN 'source_date_before_or_unverified_against_release'
  WHEN NOT (regexp_matches(low, 'crash|freeze|frozen|hang|failed|failure|bug|broken|corrupt|regression|slow|lag|performance|install|won''t open|does not open|can''t open|cannot open|decode|render|export|'
      || 'compatibility|plugin|workflow')
    AND NOT (regexp_matches(low, 'release notes|changelog|what''s new|whats new|announcement|download|version history|new features') AND NOT regexp_matches(low, 'crash|bug|broken|failed|regression'))) THEN 'not_a_real_issue_report'
  WHEN regexp_matches(said, '(?i)(^|[^\p{L}\p{N}_])(public\s+beta|beta\s*\d*|21\.0b\d*|21b\d+|21\.0b\s+build\s+20|build\s+20)($|[^\p{L}\p{N}_])') THEN 'beta_context_for_stable_record'
  WHEN NOT regexp_matches(said, '(?i)(^|[^\p{L}\p{N}_])resolve($|[^\p{L}\p{N}_])') AND NOT regexp_matches(said, '(?i)(^|[^\p{L}\p{N}_])davinci\s+(version\s+)?v?\d{1,2}(\.\d+){0,2}($|[^\p{L}\p{N}_])')
  THEN 'missing_davinci_product_context'
  WHEN len(list_filter(majors, lambda m: m::INT <> major)) > 0 THEN 'conflicting_davinci_version_context'
  WHEN NOT regexp_matches(said, '(?i)(^|[^\p{L}\p{N}_])(crash(es|ed|ing)?|freez(e|es|ing|en)|hang(s|ing)?|fail(ed|s|ure|ing)?|error|bug|broke|broken|breaks|corrupt(ed|ion)?|regression|slow|lag(gy)?|won''t\s+open|'
      || 'can''t\s+open|cannot\s+open|does\s+not\s+open|decode|install(ation)?\s+issue|problem)($|[^\p{L}\p{N}_])') THEN 'not_a_real_issue_report' END AS reason
FROM w"""
)


def candidates(t: Tables) -> DataFrame:
    """Reports with the records whose version they name."""
    docs = t.documents.select(F.col("doc_id").alias("n"), "text").unionByName(t.pages.select((F.col("page_id") + 1_000_000_000).alias("n"), F.col("html").alias("text")))
    turn = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("n") % len(words)).cast("int") + 1)
    dated: Column = F.when(F.col("n") % 5 == 1, "2024-01-10").when(F.col("n") % 5 != 0, "2024-03-01T08:00:00Z")
    reports = docs.select(
        "n", turn(TITLES).alias("report_title"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), turn(ENDINGS)).alias("report_text"),
        F.when(F.col("n") % 7 == 0, "https://github.com/a/b/issues").otherwise(F.concat(F.lit("https://github.com/a/b/issues/"), "n")).alias("source_url"), dated.alias("source_date"),
        F.lit(None).cast("string").alias("parent_title"),
    )
    version = F.concat((F.col("p_size") % 3 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 2).cast("string"))
    records = t.part.select(version.alias("update_version"), F.lit("2024-02-01").alias("target_release_date")).distinct()
    return products.candidates_for(records, reports)


@query(OBS_SQL)
def recorder_reports(t: Tables):
    """Reasons of the recorder's chain on every document and page that names one of its versions."""
    return products.decide(candidates(t), "obs-studio").select("n", F.col("update_version").alias("version"), F.col("exclusion_reason").alias("reason"))


@query(RESOLVE_SQL)
def video_suite_reports(t: Tables):
    """Reasons of the video suite's chain on the same reports."""
    return products.decide(candidates(t), "blackmagic-davinci").select("n", F.col("update_version").alias("version"), F.col("exclusion_reason").alias("reason"))
