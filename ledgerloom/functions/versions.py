"""Version columns: exact mentions, sort keys, channels, aliases, the suite's version forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def mentions(text: Column, version: Column) -> Column:
    """The version stands in the text with no letter, digit or point on either side (case-blind)."""
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9.])\Q"), F.replace(version, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9.])"))
    return F.coalesce(F.regexp_like(text, pattern) & (F.trim(version) != ""), F.lit(False))


def exact_match(text: Column, version: Column, aliases: Column) -> Column:
    """``struct(version, basis)`` of the first of the version and its aliases that the text mentions, else null."""
    hit = F.get(F.filter(aliases, lambda a: mentions(text, a)), F.lit(0))
    made = lambda v, basis: F.struct(v.alias("version"), F.lit(basis).alias("basis"))
    return F.when(mentions(text, version), made(version, "exact_version_text")).when(hit.isNotNull(), made(hit, "exact_version_alias"))


def all_mentions(text: Column) -> Column:
    """Dotted numbers of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0))


def int_tuple(version: Column) -> Column:
    """The parts between points as integers (others 0): arrays that sort as versions do."""
    return F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def natural_key(version: Column, width: int = 12) -> Column:
    """Lower case with every run of digits padded, so that text order is natural order."""
    padded = F.regexp_replace(F.lower(F.coalesce(version, F.lit(""))), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def channel(text: Column) -> Column:
    beta = r"(?i)\b(?:beta|public\s+beta|preview|pre[- ]?release|rc)\b"
    return F.when(F.coalesce(text, F.lit("")).rlike(beta), F.lit("beta")).otherwise(F.lit("stable"))


def short_matches(short: Column, full: Column) -> Column:
    """Equal, or the start of the full version up to a point."""
    return (full == short) | F.startswith(full, F.concat(short, F.lit(".")))


def aliases(version: Column, names: tuple[str, ...]) -> Column:
    """Forms in which a version of two parts is written: with .0, and after each product name."""
    forms = F.when(version.rlike(r"^\d+\.\d+$"), F.array(version, F.concat(version, F.lit(".0")))).otherwise(F.array(version))
    named = F.transform(forms, lambda v: F.concat(F.array(v), *[F.array(F.concat(F.lit(n + " "), v)) for n in names]))
    return F.array_except(F.array_distinct(F.flatten(named)), F.array(version))


def most_specific(text: Column) -> Column:
    """Of all mentions the one with most points, then the longest, then the last in text order."""
    rank = lambda v: F.struct((F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))).alias("points"), F.length(v).alias("n"), v.alias("v"))
    return F.array_max(F.transform(all_mentions(text), rank))["v"]


# Forms of the video suite's versions, once the product's name is off.
_SUITE_PREFIX = r"(?i)^(?:blackmagic\s+)?(?:davinci\s+resolve|davinci|resolve)(?:\s+studio)?\s+(?:version\s+)?"
_SUITE_BETA = r"(?i)^v?(\d{1,2})(?:\.(\d+))?(?:\.(\d+))?\s*(?:public\s+beta\s*|beta\s*|b\s*)(\d+)(?:\s+build\s+\d+)?$"
_SUITE_STABLE = r"(?i)^v?(\d{1,2})(?:\.(\d+))?(?:\.(\d+))?$"


def normalize_suite(raw: Column) -> Column:
    """``struct(version, is_beta, beta_number, major, minor, rejected, reason)`` of the video suite's version in any of its written forms.

    Betas become ``<major> Public Beta <n>``; abbreviations, wildcards, the
    tier's name alone, betas without a number and anything else are rejected with the reason.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    core = F.trim(F.regexp_replace(F.regexp_replace(text, _SUITE_PREFIX, ""), r"(?i)\s+studio$", ""))
    beta, stable = (lambda g: F.regexp_extract(core, _SUITE_BETA, g)), (lambda g: F.regexp_extract(core, _SUITE_STABLE, g))
    points = lambda part: F.nullif(F.concat_ws(".", F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit(""))), F.lit(""))
    reason = (
        F.when(text == "", "empty_or_invalid_input").when(core.rlike(r"(?i)^dr\s*\d"), "abbreviation_dr_ambiguous").when(core.rlike(r"(?i)\d\.x"), "wildcard_version")
        .when(F.lower(core).isin("studio", ""), "studio_tier_not_a_version").when(core.rlike(r"(?i)^v?\d{1,2}(?:\.\d+)*\s*(?:public\s+)?(?:beta|b)$"), "ambiguous_beta_no_number")
        .when((beta(4) == "") & (stable(1) == ""), "unrecognized_version_format")
    )
    is_beta = beta(4) != ""
    number = lambda c: c.try_cast("int")
    name = F.when(is_beta, F.concat_ws(" ", number(beta(1)).cast("string"), F.lit("Public Beta"), number(beta(4)).cast("string"))).otherwise(F.concat_ws(".", number(stable(1)).cast("string"), points(stable)))
    ok = reason.isNull()
    return F.struct(
        F.when(ok, name).alias("version"), F.when(ok, is_beta).alias("is_beta"), F.when(ok & is_beta, number(beta(4))).alias("beta_number"),
        F.when(ok, F.coalesce(number(beta(1)), number(stable(1)))).alias("major"), F.when(ok, F.coalesce(points(beta), points(stable))).alias("minor"), (~ok).alias("rejected"), reason.alias("reason"),
    )


def normalize_release(raw: Column, product: str) -> Column:
    """``struct(version, channel)`` of a release title, or null: the product's name off, beta forms told apart.

    ``Name 19.1.2`` is stable 19.1.2; ``Name 20 Public Beta 3`` is beta ``20-beta-3``; anything else is rejected.
    """
    text = F.regexp_replace(F.lower(F.trim(raw)), rf"^{re.escape(product.lower())}(?:\s+studio)?\s+", "")
    number = r"^v?(\d+(?:\.\d+){0,3})"
    stable = F.regexp_extract(text, number + r"(?:\s+update)?$", 1)
    beta, nth = (F.regexp_extract(text, number + r"\s+(?:public\s+)?beta\s*(\d*)$", g) for g in (1, 2))
    made = lambda v, c: F.struct(v.alias("version"), F.lit(c).alias("channel"))
    return F.when(stable != "", made(stable, "stable")).when(
        beta != "", made(F.concat(beta, F.lit("-beta-"), F.coalesce(F.nullif(nth, F.lit("")), F.lit("1"))), "beta")
    )
