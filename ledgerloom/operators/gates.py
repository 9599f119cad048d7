"""Ordered, fail-closed gates: the first rule that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, urls
from ledgerloom.functions.text import normal


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition for rejection is true (null counts as false), else null."""
    out = None
    for name, fails in rules:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def gated(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``exclusion_reason`` and ``counted``."""
    return rows.withColumn("exclusion_reason", first_failure(rules)).withColumn("counted", F.col("exclusion_reason").isNull())


def acceptance(report_text: Column, issue_terms: tuple[str, ...]) -> list[tuple[str, Column]]:
    """The common chain: version, specific URL, release date (false only), issue language."""
    return [
        ("missing_exact_patch_version_match", ~F.coalesce(F.col("patch_version_matched"), F.lit(False))),
        ("source_url_not_specific_report", ~urls.specific_report(F.col("source_url"))),
        ("source_date_before_or_unverified_against_release", F.col("source_date_pass").eqNullSafe(F.lit(False))),
        ("not_a_real_issue_report", ~buckets.describes_issue(report_text, issue_terms)),
    ]


def inclusion() -> list[tuple[str, Column]]:
    """The chain by which evidence enters a consensus."""
    severity = F.lower(normal(F.col("severity")))
    return [
        ("gate_11_missing_source_url", normal(F.col("source_url")) == ""),
        ("gate_12_patch_version_matched_false", ~F.col("patch_version_matched").eqNullSafe(F.lit(True))),
        ("gate_13_counted_false", F.col("counted").eqNullSafe(F.lit(False))),
        ("invalid_sentiment", ~F.lower(normal(F.col("sentiment"))).isin(*buckets.SENTIMENTS)),
        ("invalid_severity", (severity != "") & ~severity.isin(*buckets.SEVERITIES)),
    ]


def windows_identity(row: str = "", target: str = "") -> list[tuple[str, Column]]:
    """Build equality, or KB and feature train equality, against the record's current identity; dates on or after."""
    c = lambda name: normal(F.col(row + name))
    t = lambda name: normal(F.col(target + name))
    build, kb, train = c("matched_os_build"), c("matched_kb"), c("matched_feature_version")
    t_build, t_kb = t("target_os_build"), t("target_kb")
    t_train = F.when(t("target_feature_version") != "", t("target_feature_version")).otherwise(t("update_version"))
    ok = ((t_build != "") & (build == t_build)) | ((t_kb != "") & (kb == t_kb) & (t_train != "") & (train == t_train))
    passes = dates.date_passes(F.col(row + "source_date"), F.col(target + "target_release_date"))
    return [
        ("windows_record_missing_target_identity", (t_build == "") & (t_kb == "")),
        ("missing_kb_or_build", (build == "") & (kb == "")),
        ("wrong_feature_train_for_kb", ~ok & (kb != "") & (kb == t_kb) & (train != "") & (train != t_train)),
        ("stale_due_to_patch_rollover", ~ok),
        ("source_date_before_target_release_date", passes.eqNullSafe(F.lit(False))),
    ]


def authoritative(counted: Column, matched: Column) -> Column:
    """Counted unless it says no, and matched only if it says yes."""
    return ~counted.eqNullSafe(F.lit(False)) & matched.eqNullSafe(F.lit(True))


def reason_histogram(rows: DataFrame, reason: str = "exclusion_reason") -> DataFrame:
    """Number of rows of each reason; counted rows under ``included``."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))
