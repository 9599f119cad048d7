"""What is stored and shown: evidence and method rows, new records, gates before a write, status events, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, ladders, text, versions
from ledgerloom.functions.text import known, normal
from ledgerloom.operators.gates import first_failure

KEY = ("product_id", "update_version")


def flag(c: Column) -> Column:
    """A boolean; null is false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def count_of(c: Column) -> Column:
    """A whole number; null and text that is none are 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def evidence_rows(candidates: DataFrame, captured_at: Column) -> DataFrame:
    """Evidence rows of judged candidates: derived id, excerpt, date test, coerced flags and weight.

    Columns that a candidate lacks are blank; other columns are dropped. The
    id is the candidate's own, or product, version, source type and URL as slugs.
    """
    has = lambda name: F.col(name) if name in candidates.columns else F.lit(None).cast("string")
    parts = [normal(F.col("product_id")), *[text.slugify(normal(has(c))) for c in ("update_version", "source_type", "source_url")]]
    blank = lambda *names: [normal(has(n)).alias(n) for n in names]
    weight = count_of(has("source_weight"))
    return candidates.select(
        F.coalesce(known(has("id")), F.concat_ws("-", *parts)).alias("id"),
        *blank("product_id", "update_version", "source_type", "source_name", "source_url", "parent_title", "report_title"),
        text.excerpt(has("report_text")).alias("report_text_excerpt"), F.coalesce(known(has("captured_at")), captured_at.cast("string")).alias("captured_at"),
        *blank("source_date", "target_release_date"), dates.date_passes(has("source_date"), has("target_release_date")).alias("source_date_pass"),
        flag(has("patch_version_matched")).alias("patch_version_matched"),
        *blank("matched_version", "match_basis", "matched_product_alias", "applicability", "matched_kb", "matched_os_build", "matched_feature_version"),
        flag(has("counted")).alias("counted"), has("exclusion_reason").cast("string").alias("exclusion_reason"),
        *blank("issue_theme", "workflow_area", "platform", "severity", "sentiment"),
        F.when(weight == 0, 1).otherwise(weight).alias("source_weight"),
    )


#: Counters of a method row and the one that each falls back to.
COUNTERS = {
    "candidates_found": None, "accepted_reports": None, "rejected_reports": None, "duplicate_existing_evidence": None,
    "accepted_candidates": "accepted_reports", "evidence_rows_added": "accepted_reports", "public_counted_reports": "accepted_reports",
}


def method_rows(runs: DataFrame) -> DataFrame:
    """Method-health rows: counters from the accepted reports where they are not given, texts never null, unknown statuses broken."""
    has = lambda name: F.col(name) if name in runs.columns else F.lit(None).cast("string")
    counter = lambda name, other: count_of(F.coalesce(has(name).try_cast("int"), has(other).try_cast("int")) if other else has(name))
    texts = ("product_id", "update_version", "method_id", "source_type", "blocked_reason", "last_run", "notes")
    return runs.select(
        *[normal(has(c)).alias(c) for c in texts], buckets.known_status(has("status")).alias("status"), *[counter(c, other).alias(c) for c, other in COUNTERS.items()]
    )


def method_rows_by_version(judged: DataFrame, records: DataFrame, method_id: str) -> DataFrame:
    """One method row a version from judged rows (``counted``, ``exclusion_reason``): accepted, duplicates, rejected, status, reasons.

    A duplicate is neither accepted nor rejected; accepted rows of a version
    without a record wait for it.
    """
    reason, again = F.coalesce("exclusion_reason", F.lit("unknown")), F.col("exclusion_reason").eqNullSafe(F.lit("duplicate_existing_evidence"))
    by_reason = judged.groupBy(*KEY, F.when(flag(F.col("counted")), "+").when(again, "=").otherwise(reason).alias("reason")).agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("int")
    rejected = ~F.col("reason").isin("+", "=")
    listed = F.array_sort(F.collect_list(F.when(rejected, F.concat_ws("=", "reason", "n"))))  # reasons are a fixed list
    counts = by_reason.groupBy(*KEY).agg(
        n(F.col("reason") == "+").alias("accepted_reports"), n(F.col("reason") == "=").alias("duplicate_existing_evidence"), n(rejected).alias("rejected_reports"), listed.alias("reasons")
    )
    rows = counts.join(records.select(*KEY).distinct().withColumn("has_record", F.lit(True)), list(KEY), "left")
    took, lost = F.col("accepted_reports") > 0, F.col("rejected_reports") > 0
    status = F.when(took & lost, "partial").when(took & F.col("has_record"), "success").when(took, "manual_review_needed").otherwise("no_results")
    notes = F.when(F.size("reasons") > 0, F.concat(F.lit("Rejected candidates: "), F.array_join("reasons", ", "), F.lit("."))).otherwise("")
    found = F.col("accepted_reports") + F.col("duplicate_existing_evidence") + F.col("rejected_reports")
    return method_rows(rows.withColumns({"method_id": F.lit(method_id), "status": status, "notes": notes, "candidates_found": found}))


def public_rows(rows: DataFrame) -> DataFrame:
    """What of a report is shown: titles with fallbacks, a plain date, issue in words."""
    bucket = ladders.public_bucket(F.col("product_id"), F.col("issue_theme"), F.col("workflow_area"), F.col("report_title"), F.col("parent_title"))
    source = text.public_phrase(F.col("source_type"))
    return rows.select(
        "id", text.first_known(F.col("source_name"), F.col("source_type"), F.lit("Source")).alias("source_name"),
        F.when(source == "", "community report").otherwise(source).alias("source_type"), "source_url",
        text.first_known(F.col("report_title"), F.col("parent_title"), F.lit("Community report")).alias("source_title"),
        F.coalesce(F.date_format(dates.parse_iso(F.col("source_date")), "yyyy-MM-dd"), F.lit("")).alias("source_date"),
        text.first_known(F.col("matched_version"), F.col("update_version")).alias("version_matched"),
        ladders.sample_issue(bucket, F.col("workflow_area")).alias("issue"), text.public_phrase(F.col("workflow_area")).alias("workflow_area"),
    )


def promotion() -> Column:
    """``struct(blocker, decision)`` of a candidate with ``duplicate, target_record, body_accessed, body_verified, category, exact_match, date_passes, issue_report``."""
    seen = flag(F.col("body_accessed")) | flag(F.col("body_verified"))
    blocker = first_failure(
        [
            ("duplicate_existing_evidence", flag(F.col("duplicate"))),
            ("future_update_not_current_record", F.col("target_record") == "future"),
            ("needs_user_verification", ~seen & (F.col("category") == "issue_report_candidate")),
            ("ambiguous_or_non_exact_version", (F.col("target_record") == "ambiguous") | ~flag(F.col("exact_match"))),
            ("not_user_issue_report_evidence", F.col("category").isin("release_metadata", "discovery_source", "release_discussion")),
            ("source_published_before_patch_release", F.col("date_passes").eqNullSafe(F.lit(False))),
            ("source_date_unverified", F.col("date_passes").isNull()),
            ("not_an_actual_issue_report", ~flag(F.col("issue_report"))),
            ("needs_user_verification", ~seen),
            ("manual_review_required_before_promotion", ~flag(F.col("body_verified"))),
        ]
    )
    decision = (
        F.when(blocker.isNull(), "promote_now").when(blocker == "duplicate_existing_evidence", blocker)
        .when(F.col("target_record") == "future", "future_update_not_current_record")
        .when(blocker.isin("needs_user_verification", "manual_review_required_before_promotion", "source_date_unverified"), "needs_user_verification")
        .when((F.col("target_record") == "ambiguous") | (blocker == "ambiguous_or_non_exact_version"), "ambiguous_version").otherwise("reject")
    )
    return F.struct(blocker.alias("blocker"), decision.alias("decision"))


def promotable(rows: DataFrame, stored: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows that may be promoted: no required field blank, counted with weight 1, not stored yet; and what is missing of the others."""
    missing = F.array_compact(F.array(*[F.when(normal(F.col(c)) == "", F.lit(c)) for c in required]))
    held = stored.select(*KEY, "source_url").distinct().withColumn("stored", F.lit(True))
    out = rows.withColumn("missing_fields", missing).join(held, [*KEY, "source_url"], "left")
    ok = (F.size("missing_fields") == 0) & flag(F.col("counted")) & (F.col("source_weight") == 1) & F.col("stored").isNull()
    return out.withColumn("promotable", F.coalesce(ok, F.lit(False))).withColumn("duplicate", flag(F.col("stored"))).drop("stored")


def release_gates(rows: DataFrame, records: DataFrame, candidates: bool = False) -> DataFrame:
    """The gates before a record's count is written, for each product version of the rows: failed ones and whether it may be written.

    ``n`` counts included rows (column ``included``; without it all are), and
    gates look at these alone. A version without a record fails, one without a
    number by a reason of its own. ``candidates`` asks of rows what candidates
    owe: an exact match, and not to be left out of the dry run. ``warnings``
    holds gates that block nothing: a count kept by hand that no row backs;
    ``n_access_limited`` counts rows whose access was limited. That the count is
    the number of its rows holds by construction. Rows are reduced to one row a
    version before records are met.
    """
    at = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    inside = F.coalesce(at("included").cast("boolean"), F.lit("included" not in rows.columns))
    count = lambda c: F.count_if(inside & F.coalesce(c, F.lit(True)))
    yes, no = (lambda c: at(c).eqNullSafe(F.lit(True))), (lambda c: at(c).eqNullSafe(F.lit(False)))
    asked, left_out = ("exact_version_match", "include_in_dry_run") if candidates else ("patch_version_matched", "counted")
    access = F.lower(normal(at("access_status")))
    counts = rows.groupBy(*KEY).agg(
        F.count_if(inside).alias("n"), count(normal(F.col("row_version")) != normal(F.col("update_version"))).alias("other_version"),
        count(normal(F.col("row_version")) == "").alias("no_version"), count(normal(F.col("source_url")) == "").alias("no_url"),
        count(~yes(asked)).alias("unmatched"), count(no(left_out)).alias("left_out"), count(no("source_date_pass")).alias("early"),
        count(F.contains(access, F.lit("blocked")) | F.contains(access, F.lit("limited"))).alias("n_access_limited"),
    )
    legacy = F.col("legacy_manual_report_count") if "legacy_manual_report_count" in records.columns else F.lit(None)
    shown = records.select(*KEY, F.lit(True).alias("has_record"), legacy.cast("long").alias("legacy"))
    made = counts.join(shown, list(KEY), "left")
    missing = F.col("has_record").isNull()
    gates = [
        ("gate_03_product_id_matches_record", missing), ("gate_04_version_matches_record", missing), ("gate_05_no_beta_stable_cross_match", F.col("other_version") > 0),
        ("gate_08_no_ambiguous_versions", F.col("no_version") > 0), ("gate_09_record_must_exist_for_write", missing), ("gate_11_source_url_required", F.col("no_url") > 0),
        (f"gate_12_{asked}_required", F.col("unmatched") > 0), (f"gate_13_{left_out}_required", F.col("left_out") > 0),
    ] + ([] if candidates else [("gate_16_source_date_gate_required", F.col("early") > 0)])
    failed = F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in gates])
    unnamed = normal(F.col("update_version")) == ""
    failed = F.when(unnamed, "all_rows_excluded_no_version").otherwise(failed)
    n = F.when(unnamed, 0).otherwise(F.col("n"))
    unbacked = (n == 0) & (F.col("legacy") == 0)
    return made.select(
        *KEY, n.alias("n"), failed.alias("write_blocked_reason"), (failed == "").alias("would_write"),
        F.when(F.coalesce(unbacked, F.lit(False)), "gate_06_legacy_count_not_verified").otherwise("").alias("warnings"),
        F.when(unnamed, 0).otherwise(F.col("n_access_limited")).alias("n_access_limited"),
    )


# Words that public texts must not hold.
INTERNAL_TERMS = (
    "consensus_evidence.yml", "deterministically accepted", "source-backed", "source_weight", "promoted evidence rows", "promoted rows", "write-back", "writeback",
    "verified reports set", "not broad consensus", "low-confidence", "low confidence", "broad consensus", "yaml", "collector", "candidate rows",
)


def internal(c: Column, *more: str) -> Column:
    """The text holds a word that is not for the public."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, (*INTERNAL_TERMS, *more))), lambda t: F.contains(lowered, t))


def clean_events(events: Column) -> Column:
    """Status events (``at, label, note``) with internal labels and notes in public words."""

    def public(e: Column) -> Column:
        label = F.lower(F.coalesce(e["label"], F.lit("")))
        short, told = F.contains(label, F.lit("insufficient")), F.contains(label, F.lit("report")) | F.contains(label, F.lit("verified"))
        said = F.when(short, "Insufficient data").when(told, "User reports found").otherwise("Record updated")
        note = (
            F.when(short, "Record status updated after the latest source check.").when(told, "User report count updated after the latest evidence pass.")
            .otherwise("Record status updated after the latest evidence pass.")
        )
        return F.struct(
            e["at"].alias("at"), F.when(internal(e["label"]), said).otherwise(e["label"]).alias("label"), F.when(internal(e["note"], "evidence state"), note).otherwise(e["note"]).alias("note")
        )

    return F.transform(F.coalesce(events, F.array().cast("array<struct<at:string,label:string,note:string>>")), public)


def write_plan(stored: DataFrame, proposed: DataFrame, fields: list[str], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Stored records (``fields``, ``status_events``) after the proposed ones (``fields``, ``event`` or null), and why an event was added or not.

    A field is written if it differs; an event is added only with a
    substantive change, and only if it says something else than the last one.
    Without a change only unclean events are cleaned. Records for which
    nothing is proposed stay.
    """
    a = stored.select(*keys, F.struct(*fields).alias("was"), F.col("status_events").alias("events"))
    b = proposed.select(*keys, F.struct(*fields).alias("now"), "event")
    both = a.join(b, list(keys), "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col("was")[c].eqNullSafe(F.col("now")[c])
    asked = F.col("now").isNotNull()
    changed = asked & differs
    sign = lambda e: F.concat_ws("|", text.collapse(F.lower(e["label"])), text.collapse(F.lower(e["note"])))
    cleaned = clean_events(F.col("events"))
    new = F.get(clean_events(F.array("event")), F.lit(0))
    same = F.coalesce(sign(F.try_element_at(cleaned, F.lit(-1))) == sign(new), F.lit(False)) & (F.size(cleaned) > 0)
    reason = (
        F.when(F.col("event").isNull(), "not_requested").when(~changed, "skipped_no_substantive_record_change").when(same, "skipped_latest_status_event_equivalent")
        .otherwise("applied_substantive_record_change")
    )
    after = F.when(reason == "applied_substantive_record_change", F.concat(cleaned, F.array("event"))).when(asked & ~changed & (cleaned != F.col("events")), cleaned).otherwise(F.col("events"))
    return both.select(
        *keys, *[F.when(changed, F.col("now")[c]).otherwise(F.col("was")[c]).alias(c) for c in fields], after.alias("status_events"), changed.alias("substantive_change"), reason.alias("event_reason")
    )


def new_records(found: DataFrame, now: Column) -> DataFrame:
    """Records of releases that are met for the first time: every field with its default, permalink and path from slugs.

    ``found`` has company_id, product_id, software, company, version, title, published_at, source_url, official_url, body, summary, report_count and source_type.
    """
    c = lambda *names: text.first_known(*[F.col(n) for n in names])
    version = F.coalesce(known(F.col("version")), known(F.col("title")), F.lit("Update"))
    software, company = c("software", "product_id"), c("company", "company_id")
    published, clock = F.coalesce(known(F.col("published_at")), now.cast("string")), now.cast("string")
    n, slug, url, kind = count_of(F.col("report_count")), text.slugify(version), c("source_url", "official_url"), F.coalesce(known(F.col("source_type")), F.lit("official-source"))
    notes = text.normal_notes(F.coalesce(known(F.col("body")), F.lit("No official release-note body was captured.")))
    named = F.concat_ws(" ", software, version)
    given = {
        "title": F.concat(named, F.lit(" official update breakdown")), "description": F.format_string("Official %s update record captured from %s.", software, company),
        "permalink": F.concat(F.lit("/updates/"), F.col("company_id"), F.lit("/"), F.col("product_id"), F.lit("/"), slug, F.lit("/")),
        "path": F.concat_ws("-", F.substring(published, 1, 10), text.slugify(software), F.concat(slug, F.lit(".md"))),
        "update_entry": F.lit(True), "company_id": F.col("company_id"), "product_id": F.col("product_id"), "update_product": software, "update_version": version,
        "update_logo_text": F.upper(F.substring(software, 1, 3)), "update_source_name": company, "update_source_url": url, "update_published_at": published,
        "update_last_checked": clock, "source_last_checked": clock, "record_last_updated": clock, "update_status": F.lit("current"), "update_feed_title": named,
        "update_consensus_label": F.lit("Insufficient data"), "update_report_count": n, "update_consensus_confidence": F.lit("Low"),
        "quick_verdict": F.concat(named, F.lit(" has an official record; patch-specific reports are not collected yet.")),
        "official_summary": F.concat(company, F.lit(" published "), named, F.lit(".")), "release_summary": F.coalesce(known(F.col("summary")), text.summarize(notes)),
        "evidence_state": buckets.evidence_state(n), "evidence_state_label": buckets.evidence_state_label(n), "intelligence_stage": F.when(n > 0, "pilot").otherwise("official_live"),
        "official_source_captured": (url != "") | (notes != ""), "confirmed_patch_specific_report_count": n, "consensus_collection_status": buckets.collection_status(n),
        "consensus_match_policy": F.lit("confirmed_patch_specific_reports_v1"), "consensus_report_weighting": F.lit("equal_per_confirmed_report"), "consensus_low_context_policy": F.lit("excluded"),
        "official_note_status": F.when(kind.isin("release_notes", "fixed_issues", "security_advisory", "changelog"), "release_notes_captured").otherwise("official_source_captured"),
        "official_note_label": F.when(kind == "release_notes", "Official release notes").otherwise("Official source summary"), "official_source_type": kind,
        "primary_official_source": c("official_url", "source_url"), "official_patch_notes_body": notes,
        "status_events": F.array(F.struct(published.alias("at"), F.lit("Published").alias("label"), F.lit("Official source entry detected.").alias("note"))),
    }
    return found.select(*[v.alias(k) for k, v in given.items()])


def limitation(count: Column, reddit: Column, confidence: Column) -> Column:
    """What limits a sample of reports, in a sentence."""
    return (
        F.when(count <= 0, "No user reports found yet.").when(count <= 2, "Too few reports for a firm verdict yet.")
        .when((reddit > 0) & (reddit / count >= 0.6), "Current reports are Reddit-heavy, so production users should test before updating.")
        .when(F.lower(confidence).isin("low", "insufficient"), "Small sample size; production users should test before updating.")
        .otherwise("This is a surfaced user-report sample, not a live telemetry feed.")
    )


def affected_workflow(product: Column, beta: Column, label: Column, themes: Column) -> Column:
    """Who should wait, in a sentence; ``themes`` are the leading issues in words."""
    words, label = F.lower(F.coalesce(themes, F.lit(""))), F.lower(label)
    busy = F.contains(words, F.lit("export")) | F.contains(words, F.lit("render"))
    resolve = product == "blackmagic-davinci"
    return (
        F.when(resolve & beta, "Production editors should avoid it on active projects; test only in disposable or non-critical projects.")
        .when(resolve & busy, "Production editors with active export deadlines should wait unless they need a specific fix.")
        .when(resolve, "Production editors should test on copied projects before moving active work to this version.")
        .when(product == "obs-studio", "Streamers and recording setups with stable scenes, plugins, or capture devices should wait or test on a backup profile.")
        .when(label == "negative", "Users with fragile production workflows should wait unless they need a specific fix.")
        .when(label == "positive", "Most users can test the update, while critical workflows should still keep a rollback path.")
        .otherwise("Users with fragile workflows should test first before upgrading production systems.")
    )


def cluster_sentence(themes: Column) -> Column:
    """The leading issues (an array) in a sentence."""
    return F.when(F.size(themes) > 0, F.concat(F.lit("Current reports mention "), text.prose_list(themes), F.lit("."))).otherwise("Current reports are too varied to group cleanly.")


def public_summary(product: Column, name: Column, version: Column, count: Column, reddit: Column, label: Column, confidence: Column, themes: Column) -> Column:
    """The record's summary: verdict, size of the sample, issues, who is affected, limits."""
    beta = versions.channel(version) == "beta"
    none = F.concat(F.lit("INSUFFICIENT DATA: "), name, F.lit(" "), version, F.lit(" has no user reports found yet. Use the official source only until reports are available."))
    head = F.concat(
        buckets.recommendation(label, count, beta), F.lit(": "), name, F.lit(" "), version, F.lit(" has "), count.cast("string"), F.lit(" user "), F.when(count == 1, "report").otherwise("reports"), F.lit(" found.")
    )
    size = F.when(count < 8, "Small sample size.").otherwise("User reports show a repeat pattern.")
    rest = affected_workflow(product, beta, label, F.array_join(themes, " "))
    return F.when(count <= 0, none).otherwise(F.concat_ws(" ", head, size, cluster_sentence(themes), rest, limitation(count, reddit, confidence)))


def policy_audit(records: DataFrame) -> DataFrame:
    """Totals over records that are updates: how many, with reports, reports in all, and each warning's number."""
    n, status = count_of(F.col("update_report_count")), F.coalesce(known(F.col("consensus_collection_status")), F.lit("unknown"))
    warnings = {
        "missing_or_legacy_consensus_policy": ~F.col("consensus_match_policy").eqNullSafe(F.lit("confirmed_patch_specific_reports_v1")),
        "low_context_policy_not_excluded": F.coalesce(F.col("consensus_low_context_policy") != "excluded", F.lit(False)),
        "report_weighting_not_equal": F.coalesce(F.col("consensus_report_weighting") != "equal_per_confirmed_report", F.lit(False)),
        "record_has_reports_but_collection_status_not_static_or_live": (n > 0) & status.isin("deferred_official_only", "unknown"),
    }
    any_of = F.lit(False)
    for w in warnings.values():
        any_of = any_of | w
    return records.where(flag(F.col("update_entry"))).agg(
        F.count("*").alias("record_count"), F.count_if(n > 0).alias("records_with_reports"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_reports"),
        F.count_if(any_of).alias("records_with_warnings"), *[F.count_if(w).alias(name) for name, w in warnings.items()],
    )


def run_summary(collectors: DataFrame) -> DataFrame:
    """Totals of a run's collectors (``product_id, ok, rolled_back, accepted, rejected``) and its outcome; a failed rollback fails the run."""
    ok = flag(F.col("ok"))
    totals = collectors.agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.count_if(~ok & ~flag(F.col("rolled_back"))).alias("unsafe"),
        F.coalesce(F.sum(F.when(ok, F.col("accepted"))), F.lit(0)).cast("long").alias("accepted_count"), F.coalesce(F.sum(F.when(ok, F.col("rejected"))), F.lit(0)).cast("long").alias("rejected_count"),
    )
    outcome = F.when(F.col("unsafe") > 0, "failed").when(F.col("failed") == 0, "success").when(F.col("completed") > 0, "partial").otherwise("failed")
    return totals.withColumn("outcome", outcome).withColumn("writeback_eligible", (F.col("unsafe") == 0) & (F.col("completed") > 0)).drop("unsafe")


def last_known_good(stored: DataFrame, collected: DataFrame, runs: DataFrame, keys: list[str], owner: str = "product_id") -> DataFrame:
    """Stored rows with those of successful runs in their place; a failed run contributes nothing and loses nothing."""
    good = runs.where(flag(F.col("ok"))).select(owner).distinct()
    fresh = collected.join(good, owner, "left_semi")
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def promotion_summary(judged: DataFrame) -> DataFrame:
    """Counts of judged rows, and the reasons of the rejected ones as a map."""
    ok, again = flag(F.col("counted")), F.col("exclusion_reason").eqNullSafe(F.lit("duplicate_existing_evidence"))
    by_reason = judged.groupBy(ok.alias("ok"), again.alias("again"), F.coalesce("exclusion_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("reason", "n")))))  # reasons are a fixed list
    return by_reason.agg(n(F.lit(True)).alias("candidates_found"), n(F.col("ok")).alias("accepted_count"), n(~F.col("ok")).alias("rejected_count"), n(F.col("again")).alias("duplicate_existing_evidence"), reasons.alias("rejection_reasons"))


def union_first(*sources: DataFrame, key: Column) -> DataFrame:
    """Candidates of ordered sources, of each key only that of the earliest source that has it (blank keys go).

    The earliest source of a key is an aggregation joined back, so no key's rows are sorted in one task.
    """
    ranked = None
    for i, source in enumerate(sources):
        rows = source.withColumns({"source_rank": F.lit(i), "source_key": key, "source_row": F.monotonically_increasing_id()})
        ranked = rows if ranked is None else ranked.unionByName(rows, allowMissingColumns=True)
    ranked = ranked.where(F.coalesce("source_key", F.lit("")) != "")
    best = ranked.groupBy("source_key").agg(F.min(F.struct("source_rank", "source_row")).alias("best"))
    kept = ranked.join(best, "source_key").where((F.col("source_rank") == F.col("best.source_rank")) & (F.col("source_row") == F.col("best.source_row")))
    return kept.drop("source_key", "source_row", "best")


def path_conflicts(declared: DataFrame, changed: DataFrame, owner: str = "owner", path: str = "path") -> DataFrame:
    """Changed paths that their owner did not declare, and those that more than one owner changed."""
    outside = changed.join(declared.select(owner, path), [owner, path], "left_anti").select(owner, path, F.lit("undeclared").alias("conflict"))
    several = changed.groupBy(path).agg(F.min(owner).alias("first"), F.max(owner).alias("last")).where("first <> last")
    shared = changed.join(several.select(path), path, "left_semi").select(owner, path, F.lit("shared").alias("conflict"))
    return outside.unionByName(shared)


def count_alignment(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Records whose shown count is not the counted evidence's; keys without evidence are not judged."""
    shown = F.coalesce(F.nullif(count_of(F.col("update_report_count")), F.lit(0)), count_of(F.col("confirmed_patch_specific_report_count")))
    return records.join(counts, list(KEY)).select(*KEY, shown.alias("actual"), F.col("n_counted").alias("expected")).where("actual <> expected")


def windows_targets(rows: DataFrame, records: DataFrame, product: str = "microsoft-windows-11") -> DataFrame:
    """Rows of one product with the current identity of their version's record; other rows have none."""
    identity = ("target_feature_version", "target_kb", "target_os_build", "target_release_date")
    held = records.where(flag(F.col("update_entry")) & (normal(F.col("product_id")) == product) & (normal(F.col("update_version")) != ""))
    held = held.select(normal(F.col("product_id")).alias("product_id"), normal(F.col("update_version")).alias("update_version"), *[normal(F.col(c)).alias(c) for c in identity])
    held = held.dropDuplicates(["product_id", "update_version"])
    return rows.drop(*identity).join(held, list(KEY), "left")


def limited_sources(keys: DataFrame, methods: DataFrame) -> DataFrame:
    """Keys of which a method was blocked, partial, broken or of low confidence."""
    hurt = methods.where(F.lower(normal(F.col("status"))).isin("blocked", "partial", "low_confidence", "broken"))
    return keys.join(hurt.select(*KEY), list(KEY), "left_semi")


def refreshable(records: DataFrame, retry: tuple[str, ...]) -> DataFrame:
    """Records whose notes are to be fetched again: none captured yet, a status to retry, an http(s) source."""
    url = text.first_known(F.col("official_patch_notes_source_url"), F.col("update_source_url"))
    wanted = flag(F.col("update_entry")) & (normal(F.col("official_patch_notes_body")) == "") & normal(F.col("official_patch_notes_capture_status")).isin(*retry)
    return records.where(wanted & url.rlike("^https?://")).withColumn("refresh_url", url)


def captured_body(page: Column, product: Column, version: Column, least: int = 300) -> Column:
    """``struct(body, capture_status)`` of a fetched page: its article, if it names the product or the version."""
    body = text.main_body(page, least)
    names = lambda c: (normal(c) != "") & F.contains(F.lower(body), F.lower(normal(c)))
    ok = (F.length(body) >= least) & (names(product) | names(version))
    return F.struct(
        F.when(ok, body).otherwise("").alias("body"),
        F.when(page.isNull(), "official-source-unreachable").when(ok, "captured-from-primary").otherwise("official-source-parser-failed").alias("capture_status"),
    )


def health_order() -> list[Column]:
    """Sources by status, then company and software in lower case."""
    order = ("Error", "Needs adapter", "Unknown", "No new records", "Active", "Manual watch", "Disabled")
    return [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("status")), F.lit(0)), F.lit(99)), F.lower("company"), F.lower("software")]


def source_health(sources: DataFrame) -> DataFrame:
    """The source-health snapshot in its order."""
    return sources.orderBy(*health_order())


def brand_logos(brands: DataFrame, products: DataFrame) -> DataFrame:
    """Brands with the logo of the product of their id where it has one."""
    held = products.where(normal(F.col("logo_path")) != "").select(F.col("product_id").alias("brand_id"), F.col("logo_path").alias("found"))
    return brands.join(held.dropDuplicates(["brand_id"]), "brand_id", "left").withColumn("logo_path", F.coalesce("found", "logo_path")).drop("found")


def decision_label(official_only: Column, count: Column, label: Column, summary: Column, verdict: Column) -> Column:
    """The label shown: the decision, the words before the colon of summary or verdict, or no data; official records without reports have none."""
    before = lambda c: F.when(F.contains(F.coalesce(c, F.lit("")), F.lit(":")), F.trim(F.element_at(F.split(c, ":"), 1)))
    shown = F.coalesce(known(label), before(summary), before(verdict), F.lit("INSUFFICIENT DATA"))
    return F.when(official_only & (F.coalesce(count, F.lit(0)) == 0), "INSUFFICIENT DATA").otherwise(shown)


# What a record with reports tells its readers, by product and state: label, advice, recommendations.
ADVICE = {
    ("blackmagic-davinci", "beta"): (
        "WAIT for production systems",
        "Use this beta only for non-critical testing. Active client projects should stay on a known-good stable build unless a Resolve 21 beta feature is worth the risk.",
        ("Wait for production systems unless you have a specific Resolve 21 beta feature to test.", "Test beta projects separately from active client work and keep a known-good Resolve version available.",
         "Review the user report sample before using this build on deadline-sensitive work."),
    ),
    ("blackmagic-davinci", "stable"): (
        "WAIT", "{themes} Production editors with active delivery deadlines should wait or test on copied projects.",
        ("Wait if you have active render/export deadlines.", "Test on copied projects before moving client work to this version.", "Review the sample reports before updating a production workstation."),
    ),
    ("obs-studio", "archived"): (
        "WAIT", "{name} {version} is archived. Use a newer maintained OBS build unless you need this version for rollback testing or reproduction.",
        ("Test with a backup scene collection and profile before production use.", "Check plugin, capture-device, and audio-routing behavior before a live stream or paid recording.",
         "Keep a rollback installer available if your setup is already stable."),
    ),
    ("obs-studio", "current"): (
        "TEST FIRST",
        "Test on a backup profile before using this OBS build for live streams or important recordings, especially if your setup depends on plugins, capture devices, audio routing, or large scene collections.",
        ("Test with a backup scene collection and profile before production use.", "Check plugin, capture-device, and audio-routing behavior before a live stream or paid recording.",
         "Keep a rollback installer available if your setup is already stable."),
    ),
    ("adobe-premiere-pro", "any"): (
        "WAIT", "{themes} Editors with active deadlines should wait or test on copied projects before moving production work to this build.",
        ("Wait if you are in the middle of deadline-sensitive editing work.", "Test on copied projects before moving active client timelines to this version.",
         "Keep a rollback path available if your current Premiere Pro build is stable."),
    ),
}


def coherence(product: Column, version: Column, count: Column, name: Column, status: Column, themes: Column) -> Column:
    """``struct(quick_verdict, label, body, recommendations)`` of a record with reports, by product and state; null for others and without reports."""
    beta, archived = versions.channel(version) == "beta", F.lower(normal(status)) == "archived"
    states = {"beta": beta, "stable": ~beta, "archived": archived, "current": ~archived, "any": F.lit(True)}
    out = None
    for (pid, state), (label, body, advice) in ADVICE.items():
        told = F.lit(body)
        for mark, value in (("{themes}", cluster_sentence(themes)), ("{name}", name), ("{version}", version)):
            told = F.replace(told, F.lit(mark), value)
        reports = F.when((count == 1) & (product == "adobe-premiere-pro"), "report").otherwise("reports")
        kind = F.lit(" is a beta build with " if state == "beta" else " has ")
        verdict = F.concat(F.lit(f"{label}: "), name, F.lit(" "), version, kind, count.cast("string"), F.lit(" user "), reports, F.lit(" found."))
        made = F.struct(verdict.alias("quick_verdict"), F.lit(label).alias("label"), told.alias("body"), F.array(*map(F.lit, advice)).alias("recommendations"))
        case = (product == pid) & states[state] & (count > 0)
        out = F.when(case, made) if out is None else out.when(case, made)
    return out


def active(flags: dict[str, str], products: dict[str, str]) -> list[str]:
    """Products whose collectors run: those without a flag, and those whose flag is exactly ``true``."""
    return [product for product, name in products.items() if not name or flags.get(name) == "true"]


def card_enrichment(cards: DataFrame, pages: DataFrame, products: DataFrame, companies: DataFrame) -> DataFrame:
    """Cards (``url, product_name``) with the page of their URL, else the product of their name, then its company and the first logo that is known."""
    by_url = pages.select(F.col("url"), F.col("product_id").alias("_by_url")).dropDuplicates(["url"])
    by_name = products.select(F.lower("name").alias("_name"), F.col("product_id").alias("_by_name")).dropDuplicates(["_name"])
    rows = cards.withColumn("_name", F.lower("product_name")).join(by_url, "url", "left").join(by_name, "_name", "left")
    rows = rows.withColumn("product_id", F.coalesce("_by_url", "_by_name")).drop("_by_url", "_by_name", "_name")
    rows = rows.join(products.select("product_id", "company_id", F.col("logo").alias("_own")), "product_id", "left")
    rows = rows.join(companies.withColumnRenamed("logo", "_company"), "company_id", "left")
    return rows.withColumn("logo", text.first_known(F.col("_own"), F.col("_company"))).drop("_own", "_company")


def payload_totals(rows: DataFrame, keys: list[str], included: Column) -> DataFrame:
    """Groups, rows, included and excluded rows, and groups of which none is included: one aggregation a group, then one over all."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(included, F.lit(False))).alias("x"))
    left = F.col("n") - F.col("x")
    return groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows_seen"), F.sum(left).alias("included"), F.sum("x").alias("excluded"), F.count_if(left == 0).alias("empty_groups")
    )


def method_outcomes(runs: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Number of methods and of failed ones of each key, and the outcome: failed if all did, partial if one did."""
    counts = runs.groupBy(*keys).agg(F.count("*").alias("methods"), F.count_if(failed).alias("failed"))
    return counts.withColumn("outcome", F.when(F.col("failed") == F.col("methods"), "failed").when(F.col("failed") > 0, "partial").otherwise("success"))
