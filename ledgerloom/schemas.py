"""Declared schemas of the evidence model."""

from __future__ import annotations

EVIDENCE = """
id string, product_id string, update_version string, source_type string, source_name string, source_url string,
archive_url string, parent_title string, report_title string, report_text_excerpt string, captured_at string,
source_date string, source_date_resolved string, source_date_text string, target_release_date string,
next_release_date string, source_date_pass boolean, patch_version_matched boolean, counted boolean,
evidence_valid_for_current_patch boolean, stale_due_to_patch_rollover boolean, matched_version string,
match_basis string, version_match_confidence string, matched_product_alias string, applicability string,
matched_kb string, matched_os_build string, matched_feature_version string, exclusion_reason string,
issue_theme string, workflow_area string, platform string, severity string, sentiment string, source_weight int,
capture_method string, listing_card_title string, listing_card_category string, listing_card_date_text string
"""
METHOD_HEALTH = """
product_id string, update_version string, method_id string, source_type string, status string, candidates_found int,
accepted_candidates int, duplicate_existing_evidence int, evidence_rows_added int, public_counted_reports int,
accepted_reports int, rejected_reports int, blocked_reason string, last_run string, notes string
"""
RECORD = """
product_id string, update_version string, update_product string, update_status string, update_entry boolean,
update_published_at string, update_last_checked string, evidence_last_checked string, permalink string, title string,
update_report_count int, confirmed_patch_specific_report_count int, evidence_state string, evidence_state_label string,
consensus_collection_status string, target_os_build string, target_kb string, target_feature_version string,
target_release_date string, extras map<string,string>, body string, path string
"""
CAPTURE = """
source_url string, final_url string, source_name string, product_hint string, version_hint string, page_title string,
visible_text string, captured_at string, capture_method string, capture_status string, error_reason string,
detail_url string, title string, body_text string, source_date string
"""
RELEASE = "record_id string, version string, title string, published_at string, url string, body string, asset_name string, asset_size bigint, checksums string"
