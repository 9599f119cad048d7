"""Ladders of the evidence model: labels, tiers, states, themes, severities, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import NON_REPORT_TERMS
from ledgerloom.functions.text import normal, public_phrase

# Fixed values of the evidence model.
SENTIMENTS = ("positive", "moderate", "negative")
SEVERITIES = ("low", "medium", "high", "critical")
METHOD_STATUSES = ("success", "no_results", "partial", "blocked", "broken", "stale", "low_confidence", "manual_review_needed", "disabled")
DECISIVE_TERMS = ("crash", "bug", "broken", "failed", "regression")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def consensus_label(positive: Column, negative: Column, total: Column) -> Column:
    """Negative from 55% negative; Positive from 55% positive with no negative; else Moderate."""
    share = lambda n: n / F.nullif(total, F.lit(0)).cast("double")
    return (
        F.when(total <= 0, "Insufficient data").when(share(negative) >= 0.55, "Negative")
        .when((share(positive) >= 0.55) & (negative == 0), "Positive").otherwise("Moderate")
    )


def confidence(total: Column) -> Column:
    """Strength tier of a number of reports: cuts at 1, 8, 25 and 33."""
    return F.when(total >= 33, "High").when(total >= 25, "Medium").when(total >= 8, "Low-Medium").when(total > 0, "Low").otherwise("Insufficient")


def evidence_state(count: Column, empty: str = "official_only") -> Column:
    return F.when(count <= 0, empty).otherwise("pilot_sample")


def evidence_state_label(count: Column) -> Column:
    return F.when(count <= 0, "Official source only").otherwise("Verified reports")


def collection_status(count: Column) -> Column:
    return F.when(count <= 0, "deferred_official_only").otherwise("pilot_initial_sample")


def recommendation(label: Column, count: Column, beta: Column) -> Column:
    """The verdict that precedes a recommendation."""
    negative = F.lower(label) == "negative"
    return (
        F.when(count <= 0, "INSUFFICIENT DATA").when(beta & negative, "AVOID for production").when(negative, "WAIT")
        .when(F.lower(label) == "positive", "SAFE ENOUGH to test").otherwise("TEST FIRST")
    )


def describes_issue(text: Column, issue_terms: tuple[str, ...]) -> Column:
    """Issue language, unless it reads like an announcement with no decisive term."""
    text = F.lower(F.coalesce(text, F.lit("")))
    return _any(text, issue_terms) & ~(_any(text, NON_REPORT_TERMS) & ~_any(text, DECISIVE_TERMS))


def theme(text: Column, ladder: tuple[tuple[str, tuple[str, ...]], ...], default: Column) -> Column:
    """The first theme of a keyword ladder one of whose terms the text holds."""
    text, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, terms in ladder:
        out = F.when(_any(text, terms), name) if out is None else out.when(_any(text, terms), name)
    return out.otherwise(default)


def issue_bucket(issue_theme: Column, workflow: Column, ladder: tuple = (), title: Column | None = None) -> Column:
    """Public bucket of a report: the product's ladder, its theme, its workflow area, or the general one."""
    t, w = F.lower(public_phrase(issue_theme)), F.lower(public_phrase(workflow))
    general = F.when((t != "") & (t != "unspecified issue"), t).when((w != "") & ~F.startswith(w, F.lit("general ")), w).otherwise("general workflow reports")
    return theme(F.concat_ws(" ", t, w, public_phrase(title if title is not None else F.lit(""))), ladder, general) if ladder else general


def severity(c: Column) -> Column:
    """Lower case, blank as low."""
    return F.coalesce(F.nullif(F.lower(normal(c)), F.lit("")), F.lit("low"))


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity(c)), F.lit(0)).cast("int")


#: Verdicts in their order of risk.
VERDICTS = ("AVOID", "WAIT", "TEST FIRST", "SECURITY UPDATE", "SAFE ENOUGH", "OFFICIAL ONLY", "INSUFFICIENT DATA", "MANUAL WATCH")


def verdict_rank(label: Column) -> Column:
    """Order of verdicts in risk lists: worst first, unknown ones last."""
    text, out = F.upper(F.coalesce(label, F.lit(""))), None
    for i, word in enumerate(VERDICTS):
        out = F.when(F.contains(text, F.lit(word)), i) if out is None else out.when(F.contains(text, F.lit(word)), i)
    return out.otherwise(99)


def evidence_rank(count: Column) -> Column:
    """Tier of a number of reports, 0 to 4."""
    return F.when(count >= 33, 4).when(count >= 25, 3).when(count >= 8, 2).when(count > 0, 1).otherwise(0)


def known_status(c: Column) -> Column:
    """A method status; anything unknown is broken."""
    text = F.lower(normal(c))
    return F.when(text.isin(*METHOD_STATUSES), text).otherwise("broken")


def method_status(accepted: Column, candidates: Column, errors: Column) -> Column:
    """Status of a method's run from what it found."""
    return (
        F.when((accepted > 0) & (errors > 0), "partial").when(accepted > 0, "success").when(errors > 0, "broken")
        .when(candidates > 0, "manual_review_needed").otherwise("no_results")
    )


def source_status(enabled: Column, adapter: Column, error: Column, fetched: Column, written: Column, last_run: Column) -> Column:
    """Status of a source from its configuration and last run."""
    return (
        F.when(~enabled & (adapter == "manual_watch"), "Manual watch").when(~enabled & (normal(adapter) == ""), "Needs adapter").when(~enabled, "Disabled")
        .when(normal(error) != "", "Error").when(last_run.isNull(), "Unknown").when((fetched > 0) & (written == 0), "No new records").otherwise("Active")
    )


def error_class(c: Column) -> Column:
    """Class of an error message by what it holds."""
    return theme(
        c,
        (("rate_limited", ("429", "rate limit", "too many requests")), ("blocked", ("403", "forbidden", "captcha", "blocked")), ("not_found", ("404", "not found")),
         ("timeout", ("timed out", "timeout", "deadline")), ("parse_error", ("parse", "json", "xml"))),
        F.when(normal(c) == "", F.lit("")).otherwise("fetch_error"),
    )
