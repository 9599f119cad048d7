"""Product chains over stand-in candidates: every line item is one of the cases below, and the SQL knows its reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import products
from ledgerloom.registry import Tables, query

LEARN, ISSUE = "https://learn.microsoft.com/en-us/answers/questions/1/x", "https://github.com/a/b/issues/1"
_PAD = "x " * 40
#: Product: version, target build, KB, train, and the cases: title, text, the reason; a URL or date where it differs.
CASES: dict[str, tuple[tuple[str, str, str, str], tuple[tuple, ...]]] = {
    "microsoft-powerpoint": (
        ("2605", "20026.20076", "", ""),
        (
            ("PowerPoint 2605 crashes on save", "It crashes every time.", None), ("PowerPoint", "hello", "no_specific_source_url", "https://learn.microsoft.com/"),
            ("PowerPoint 2605 now available", "crash", "official_announcement_not_user_report"), ("Excel 2605 crash", "PowerPoint too", "product_not_powerpoint"),
            ("PowerPoint and Excel crash", "Version 2605", "product_not_powerpoint"), ("PowerPoint Version 2604 crash", "it crashes", "different_version_not_target"),
            ("PowerPoint crash", "on 2605 today", "bare_version_no_context"), ("PowerPoint crash", "since the latest update", "vague_latest_update"), ("PowerPoint crash", "it fails", "missing_powerpoint_version"),
            ("PowerPoint Version 2604 crash", "I moved on and Version 2605 crashes", "different_version_in_title"), ("PowerPoint Version 2605 crash", "mine is Version 2604", "reply_drifted_to_other_version"),
            ("PowerPoint crash", "Version 2605 and Version 2604 crash", "ambiguous_multiple_versions"), ("PowerPoint crash", "Version 2605 crashes when I...", "insufficient_source_content"),
            ("PowerPoint Version 2605 crash", "Beta Channel user", "channel_conflict"), ("PowerPoint Version 2605 crash", "from the Microsoft Store", "store_identity_unmapped"),
            ("PowerPoint Version 2605 crash", "build 20026.20099 here", "build_mismatch"), ("PowerPoint Version 2605 crash", "it crashes", "date_before_release_or_undated", LEARN, "2026-05-01"),
            ("PowerPoint Version 2605", "I can't find the compare button", "not_a_concrete_powerpoint_issue"), ("PowerPoint crash", "Office 2605 (20026.20076) crashes", None),
            ("PowerPoint 2605 crash", "upgraded from 2604 and it crashes", None),
        ),
    ),
    "microsoft-windows-11": (
        ("24H2", "26100.8737", "KB5095093", "24H2"),
        (
            ("KB5095093 24H2 printer broken", "printing fails after update", None), ("KB5095093 25H2 crash", "", "wrong_feature_train_for_kb"), ("KB5000000 crash", "", "wrong_kb_for_current_patch"),
            ("crash", "latest update", "vague_latest_update"), ("crash", "", "missing_kb_or_build"), ("crash", "in June 2026", "date_only_inference"), ("crash", "", "no_specific_source_url", "https://learn.microsoft.com/"),
            ("KB5095093 24H2", "crash after update", "date_before_release", LEARN, "2026-05-01"), ("hello", "", "generic_support_request"), ("Build", "the 26100.8737 can crash", "missing_update_attribution"),
            ("26100.8737 crash", "it can crash", None), ("crash", "our tenant is down", "tenant_service_incident_not_client_patch"), ("crash", "password reset loop", "account_backend_issue_not_patch"),
            ("Release notes", "a bug list", "official_note_not_user_report"), ("26100.8737", "hangs, but why? is this normal", "feature_question_not_regression"),
            ("26100.8737 and my nvidia driver", "hangs", "driver_update_question_not_windows_patch"), ("Hang", "OS build: 26100.8737 hangs", "build_only_in_system_specs"),
            ("Update", "26100.8737 now available", "release_announcement_not_user_report"),
        ),
    ),
    "blackmagic-davinci": (
        ("20.1", "", "", ""),
        (
            ("DaVinci Resolve 20.1 crash", "crash", None), ("Resolve 20.1 crash", "public beta", "beta_context_for_stable_record"), ("20.1 crash", "", "missing_davinci_product_context"),
            ("DaVinci Resolve 20.1 crash", "on Resolve 19 it works", "conflicting_davinci_version_context"), ("DaVinci Resolve 20.1 workflow", "odd", "not_a_real_issue_report"),
            ("DaVinci Resolve 20.10 crash", "", "missing_exact_patch_version_match"), ("DaVinci Resolve 20.1", "odd", "not_a_real_issue_report"),
        ),
    ),
    "adobe-premiere-pro": (
        ("26.2", "", "", ""),
        (
            ("Premiere Pro 26.2 crash", "", None, ISSUE, ""), ("Premiere Pro 26.2.0 crash", "", None), ("26.2 crash", "", "missing_premiere_product_context"),
            ("Premiere Pro 26.2 beta crash", "", "prerelease_context_for_stable_record"), ("26.2 in Premiere Pro crash", "build 65", "build_65_without_premiere_version_context"),
            ("Premiere Pro 26.2 how to read a crash report", "", "not_a_real_issue_report"), ("Premiere Pro 26.2 how to undo a regression", "", None),
        ),
    ),
    "adobe-acrobat-reader": (
        ("24.1", "", "", ""),
        (
            ("Acrobat Reader 24.1 crash", "", None), ("Acrobat Pro 24.1 crash", "", "wrong_product"), ("Acrobat 24.1 crash", "", "generic_acrobat_without_edition"),
            ("Acrobat Reader and Acrobat Pro 24.1 crash", "", None), ("Acrobat Reader 24.1 crash", f"{_PAD} an Acrobat Pro license", None), ("24.1 crash", "", "missing_product_attribution"),
            ("Acrobat Reader 24.1 pricing", "regression of the refund", None), ("Acrobat Reader 24.1", "odd", "not_a_real_issue_report"),
        ),
    ),
    "obs-studio": (
        ("32.1.2", "", "", ""),
        (
            ("32.1.2 crash", "it will crash", None), ("32.1.20 crash", "", "missing_exact_version"), ("32.1.2 build failure", "cmake error", "developer_or_build_only"),
            ("32.1.2 is it safe", "", "generic_or_no_concrete_issue"), ("32.1.2 crash", "", "missing_source_date", ISSUE, ""), ("32.1.2 crash", "", "before_release_date", ISSUE, "2026-05-01"),
        ),
    ),
}
_FIELDS = "n int, product_id string, report_title string, report_text string, source_url string, source_date string, update_version string, target_build string, target_kb string, target_os_build string, target_feature_version string, target_release_date string"


def candidates(spark, product: str):
    """A product's cases, numbered."""
    (version, build, kb, train), cases = CASES[product]
    rows = [(i, product, c[0], c[1], c[3] if len(c) > 3 else LEARN, c[4] if len(c) > 4 else "2026-06-05", version, build, kb, build, train, "2026-06-01") for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, _FIELDS)


_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{p}' AS product_id, [{', '.join('NULL' if c[2] is None else repr(c[2]) for c in cases)}][l_partkey % {len(cases)} + 1] AS exclusion_reason FROM lineitem WHERE l_suppkey % {len(CASES)} = {k}"
    for k, (p, (_, cases)) in enumerate(CASES.items())
)


@query(_SQL)
def product_chains(t: Tables):
    """Reasons of the chains on line items that stand for cases: each case is judged once, its lines take the reason (at most twenty rows a product are broadcast)."""
    out = None
    for k, (product, (_, cases)) in enumerate(CASES.items()):
        judged = products.decide(candidates(t.spark, product), product).select("n", "product_id", "exclusion_reason")
        lines = t.lineitem.where(F.col("l_suppkey") % len(CASES) == k).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % len(cases)).cast("int").alias("n"))
        rows = lines.join(F.broadcast(judged), "n").drop("n")
        out = rows if out is None else out.unionByName(rows)
    return out
