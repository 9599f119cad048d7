"""Keyword ladders: the first rung whose terms a text holds gives the values of a report."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import first_known, public_phrase


@dataclass(frozen=True)
class Rung:
    """Values, and the groups of terms: one of each group must stand in the text; ``pattern`` is another way in."""

    values: tuple[str | int, ...]
    groups: tuple[tuple[str, ...], ...]
    pattern: str = ""

    def holds(self, lowered: Column) -> Column:
        each = [reduce(Column.__or__, [F.contains(lowered, F.lit(t)) for t in group]) for group in self.groups]
        found = reduce(Column.__and__, each)
        return found | lowered.rlike(self.pattern) if self.pattern else found


def rung(theme: str, area: str, severity: str, *groups: tuple[str, ...], pattern: str = "") -> Rung:
    return Rung((theme, area, severity, "negative"), groups, pattern)


# Issue theme, workflow area and severity of each product's reports, in order, and what other reports get.
THEMES = {
    "blackmagic-davinci": (
        rung("magic mask crash", "color grading / Magic Mask", "high", ("magic mask",), ("crash",)),
        rung("startup or application crash", "application stability", "high", ("crash", "won't open", "does not open")),
        rung("render/export failure", "render/export", "medium", ("decode", "render", "export")),
        rung("performance regression", "timeline / GPU performance", "medium", ("gpu", "performance", "lag", "slow")),
        rung("compatibility issue", "plugins / codecs", "medium", ("plugin", "codec")),
        rung("install issue", "installation", "medium", ("install",)),
    ),
    "adobe-premiere-pro": (
        rung("export/render failure", "export/render", "high", ("export", "render")),
        rung("project open/load failure", "project opening", "high", ("project",), ("open", "load", "hang", "delay")),
        rung("timeline crash or hang", "timeline editing", "high", ("timeline",), ("crash", "freeze", "hang", "lag")),
        rung("interface lag or freezing", "editing interface", "high", ("ui", "interface", "lag", "slow")),
        rung("plugin or compatibility issue", "plugins / compatibility", "medium", ("plugin", "compatib")),
        rung("media decode or audio/video issue", "media playback", "medium", ("media", "decode", "audio", "video")),
        rung("install issue", "installation", "medium", ("install",)),
        rung("application crash or hang", "application stability", "high", ("crash", "hang", "freeze")),
    ),
    "adobe-acrobat": (
        rung("printing regression", "printing", "high", ("print",)),
        rung("signing/certificate failure", "e-signatures", "high", ("sign", "certificate")),
        rung("form behavior regression", "forms", "high", ("form",)),
        rung("install/update failure", "deployment", "high", ("install", "update", "deploy")),
        rung("PDF rendering regression", "PDF rendering", "high", ("render", "display", "blank")),
        rung("browser/plugin handoff failure", "browser integration", "medium", ("browser", "plugin", "add-in", "extension")),
        rung("performance regression", "performance", "medium", ("cpu", "memory", "slow", "performance")),
        rung("crash or launch failure", "application stability", "high", ("crash", "freeze", "hang")),
    ),
    "obs-studio": (
        rung("crash / stability", "application stability", "high", ("crashes on quit", "crash if")),
        rung("screen capture regression", "screen/window capture", "high", ("screen capture", "xcomposite", "black screen")),
        rung("visual capture artifact", "display capture / HDR workflow", "medium", ("black square", "mouse cursor")),
        rung("audio mixer regression", "audio mixer UI", "medium", ("audio mixer", "audio")),
        rung("hotkey regression", "keyboard shortcuts", "medium", ("hotkey",)),
        rung("camera/source regression", "camera source workflow", "medium", ("web camera", "camera")),
        rung("output configuration regression", "output settings", "medium", ("rescale output",)),
        rung("freeze / hang", "application stability", "high", ("freeze", "hang")),
        rung("plugin compatibility", "plugins", "medium", ("plugin",)),
    ),
    "microsoft-windows-11": (
        rung("BSOD / stop error", "system stability", "critical", ("bsod", "blue screen", "blue-screen", "bugcheck", "bug check", "stop code", "stop error"), pattern="0x[0-9a-f]{6,8}"),
        rung("boot failure", "startup / boot", "critical", ("won't boot", "wont boot", "fails to boot", "boot loop", "black screen", "no boot")),
        rung("update/install failure", "windows update", "high", ("install", "update fail", "upgrade fail", "rollback", "rolled back", "0x800", "fails to install", "won't install")),
        rung("printer regression", "printing", "high", ("printer", "printing")),
        rung("network regression", "networking", "high", ("network", "wifi", "wi-fi", "internet", "ethernet", "vpn")),
        rung("audio regression", "audio", "medium", ("audio", "sound", "microphone")),
        rung("display regression", "display / graphics", "medium", ("display", "monitor", "graphics", "gpu", "resolution", "screen")),
        rung("performance regression", "performance", "medium", ("slow", "lag", "performance", "high cpu", "memory leak")),
        rung("crash or hang", "system stability", "high", ("crash", "freeze", "hang")),
    ),
    "microsoft-powerpoint": (
        rung("file corruption / data loss", "file integrity", "critical", ("corrupt", "damaged", "data loss", "lost my work", "lost slides", "lost changes")),
        rung("save failure", "save / storage", "high", ("can't save", "cannot save", "save fail", "unable to save")),
        rung("launch / open failure", "startup", "high", ("won't open", "wont open", "cannot open", "can't open", "fails to open", "won't launch", "won't start", "fails to launch")),
        rung("slideshow failure", "presenting", "high", ("slideshow", "slide show", "presenter view")),
        rung("export failure", "export", "high", ("export",)),
        rung("animation / transition regression", "animation", "medium", ("animation", "transition")),
        rung("add-in incompatibility", "add-ins", "medium", ("add-in", "add in", "addin")),
        rung("rendering regression", "rendering", "medium", ("render", "display", "blank slide")),
        rung("performance regression", "performance", "medium", ("slow", "lag", "performance", "high cpu", "memory leak")),
        rung("install/update failure", "update", "high", ("install", "update fail")),
        rung("crash or hang", "system stability", "high", ("crash", "freeze", "hang", "not responding")),
    ),
}
OTHER_THEMES = {
    "blackmagic-davinci": ("unspecified issue", "general DaVinci Resolve workflow", "medium", "moderate"),
    "adobe-premiere-pro": ("unspecified issue", "Premiere Pro workflow", "medium", "moderate"),
    "adobe-acrobat": ("unspecified Acrobat issue", "Acrobat workflow", "medium", "negative"),
    "obs-studio": ("unspecified issue", "general OBS workflow", "medium", "moderate"),
    "microsoft-windows-11": ("unspecified Windows issue", "Windows workflow", "medium", "negative"),
    "microsoft-powerpoint": ("unspecified PowerPoint issue", "PowerPoint workflow", "medium", "negative"),
}
#: Words that name a platform, in order; products for one platform name it always.
PLATFORMS = {
    "blackmagic-davinci": (("windows", "windows"), ("macos", "macos"), ("mac", "macos"), ("linux", "linux")),
    "adobe-premiere-pro": (("windows", "windows"), ("macos", "macos"), ("mac os", "macos"), ("mac", "macos")),
    "adobe-acrobat": (("windows", "windows"), ("macos", "macos"), ("mac os", "macos"), ("mac ", "macos")),
    "obs-studio": (("windows", "windows"), ("macos", "macos"), ("linux", "linux")),
    "microsoft-windows-11": "windows",
    "microsoft-powerpoint": "windows",
}
#: Public names of issues by what theme, workflow and title say together.
BUCKETS = {
    "blackmagic-davinci": (
        Rung(("Magic Mask crashes",), (("magic mask",),)), Rung(("render/decode failures",), (("decode",), ("render", "export"))),
        Rung(("render/export failures",), (("render", "export", "delivery"),)), Rung(("startup or application crashes",), (("crash", "startup", "launch"),)),
        Rung(("performance slowdowns",), (("performance", "gpu", "slow"),)), Rung(("installation problems",), (("install",),)), Rung(("plugin issues",), (("plugin",),)),
    ),
    "obs-studio": (
        Rung(("scene list workflow regressions",), (("scene list",),)), Rung(("scene list workflow regressions",), (("scene",), ("selection",))),
        Rung(("audio mixer or routing issues",), (("audio", "mixer", "monitoring"),)), Rung(("capture-source issues",), (("capture", "camera", "xcomposite", "screen", "window"),)),
        Rung(("plugin or setup compatibility",), (("plugin", "setup", "profile"),)), Rung(("crash or stability problems",), (("crash", "freeze", "hang", "stability"),)),
        Rung(("keyboard shortcut regressions",), (("hotkey", "shortcut"),)), Rung(("output or recording regressions",), (("output", "recording", "stream"),)),
    ),
}


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often it is named.

    A lambda is also no part of the generated method of a stage: hundreds of
    tests in one such method are more than the JVM compiles.
    """
    return F.get(F.transform(F.array(value), made), F.lit(0))


def climb(lowered: Column, rungs: tuple[Rung, ...], value: int, other: Column) -> Column:
    """The ``value``-th value of the first rung that holds, else ``other``."""
    out = None
    for r in rungs:
        out = F.when(r.holds(lowered), r.values[value]) if out is None else out.when(r.holds(lowered), r.values[value])
    return other if out is None else out.otherwise(other)


def classify(text: Column, product: str) -> Column:
    """``struct(theme, area, platform, severity, sentiment)`` of a report's text: the ladder is climbed once, its number looks up the values."""
    rungs, words = THEMES[product], PLATFORMS[product]
    numbered = tuple(Rung((i,), r.groups, r.pattern) for i, r in enumerate(rungs))
    names = ("theme", "area", "severity", "sentiment")
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)]) for values in (*(r.values for r in rungs), OTHER_THEMES[product])])
    platform = lambda x: F.lit(words) if isinstance(words, str) else climb(x, tuple(Rung((to,), ((word,),)) for word, to in words), 0, F.lit("unknown"))
    values = lambda x, f: F.struct(f["theme"].alias("theme"), f["area"].alias("area"), platform(x).alias("platform"), f["severity"].alias("severity"), f["sentiment"].alias("sentiment"))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda x: once(F.get(made, climb(x, numbered, 0, F.lit(len(rungs)))), lambda f: values(x, f)))


def public_bucket(product: Column, theme: Column, workflow: Column, *titles: Column) -> Column:
    """Public name of a report's issue: its product's ladder, its theme, its workflow, or the general one."""

    def named(r: Column) -> Column:
        theme, workflow = r["theme"], r["workflow"]
        other = (
            F.when((theme != "") & (theme != "unspecified issue"), theme)
            .when((workflow != "") & ~F.startswith(workflow, F.lit("general ")), workflow).otherwise("general workflow reports")
        )
        out = None
        for name, rungs in BUCKETS.items():
            found = climb(r["said"], rungs, 0, other)
            out = F.when(r["product"] == name, found) if out is None else out.when(r["product"] == name, found)
        return out.otherwise(other)

    lowered = F.struct(*[F.lower(public_phrase(c)).alias(n) for n, c in (("theme", theme), ("workflow", workflow), ("title", first_known(*titles)))], product.alias("product"))
    joined = lambda r: F.concat_ws(" ", r["theme"], r["workflow"], r["title"])
    return once(lowered, lambda r: once(F.struct(r["theme"].alias("theme"), r["workflow"].alias("workflow"), joined(r).alias("said"), r["product"].alias("product")), named))


def sample_issue(bucket: Column, workflow: Column) -> Column:
    """``issue in workflow`` unless the issue names the workflow or it is a general one."""
    workflow = public_phrase(workflow)
    told = F.contains(F.lower(bucket), F.lower(workflow)) | F.startswith(F.lower(workflow), F.lit("general ")) | (workflow == "")
    return F.when(told, bucket).otherwise(F.concat_ws(" in ", bucket, workflow))


# Words of an error by which each policy sees a wall, and the rules of each policy in order.
WALLS = {
    "forum": ("blocked", "challenge", "waf", "captcha", "access_denied", "rate_limited", "http_429", "429", "too many requests"),
    "community": ("blocked", "challenge", "captcha", "rate_limited", "access_denied", "http_401", "http_403", "http_429"),
    "editions": ("blocked", "challenge", "captcha", "rate_limited", "http_401", "http_403", "http_429"),
}
WALLS["threads"] = WALLS["forum"]
_FOUND = (("accepted and errors", "partial"), ("accepted", "success"), ("candidates and errors", "partial"))
_ANSWERS = (("accepted and errors", "partial"), ("accepted", "success"), ("errors and seen", "partial"), ("unreadable", "broken"), ("errors", "blocked"))
POLICIES = {
    "forum": (*_FOUND, ("candidates and rejected", "no_results"), ("wall", "blocked"), ("unusable", "low_confidence"), ("errors", "broken")),
    "threads": (("candidates and errors", "partial"), ("candidates", "success"), *_FOUND[:2], ("wall", "blocked"), ("unusable", "low_confidence"), ("errors", "broken")),
    "community": (*_FOUND, ("candidates and rejected", "no_results"), ("no key", "disabled"), ("wall", "blocked"), ("errors", "broken")),
    "editions": (*_FOUND, ("candidates", "no_results"), ("wall", "blocked"), ("errors", "broken")),
    "answers": _ANSWERS,
    "answers with near misses": (*_ANSWERS, ("near miss", "low_confidence")),
    "fallback": (("not attempted", "disabled"), *_FOUND[:2], ("errors alone", "blocked"), ("errors", "partial")),
}
#: Reasons by which a rejected report nearly counted.
NEAR_MISSES = ("bare_version_no_context", "different_version_not_target", "build_mismatch", "channel_conflict", "reply_drifted_to_other_version", "insufficient_source_content")


def method_status(policy: str, candidates: Column, accepted: Column, rejected: Column, errors: Column, reasons: Column | None = None, near_misses: Column | None = None, attempted: Column | None = None) -> Column:
    """Status of a collection method from its counts and the reasons of its errors (joined), by one of the policies."""
    said = F.lower(F.coalesce(reasons if reasons is not None else F.lit(""), F.lit("")))
    some = {"candidates": candidates > 0, "accepted": accepted > 0, "rejected": rejected > 0, "errors": errors > 0}
    word = lambda *terms: some["errors"] & reduce(Column.__or__, [F.contains(said, F.lit(t)) for t in terms])
    cases = some | {
        "accepted and errors": some["accepted"] & some["errors"], "candidates and errors": some["candidates"] & some["errors"],
        "candidates and rejected": some["candidates"] & some["rejected"], "errors and seen": some["errors"] & (some["candidates"] | some["rejected"]),
        "errors alone": some["errors"] & ~some["candidates"], "wall": word(*WALLS.get(policy, ("blocked",))), "no key": word("missing_brave_search_api_key"),
        "unusable": word("unusable", "source_returned_non_forum_content"), "unreadable": word("feed_parse_failed", "broken"),
        "near miss": (near_misses if near_misses is not None else F.lit(0)) > 0, "not attempted": ~(attempted if attempted is not None else F.lit(True)),
    }
    out = None
    for case, status in POLICIES[policy]:
        out = F.when(cases[case], status) if out is None else out.when(cases[case], status)
    return out.otherwise("no_results")


def request_status(code: Column, signature: Column, candidates: Column) -> Column:
    """Status of one request from its HTTP code and what its body looked like."""
    sign = F.lower(F.coalesce(signature, F.lit("")))
    has = lambda *terms: reduce(Column.__or__, [F.contains(sign, F.lit(t)) for t in terms])
    return (
        F.when(code.isin(401, 403) | has("blocked", "challenge", "captcha"), "blocked").when((code == 429) | has("rate_limited"), "rate_limited")
        .when(has("parse", "invalid_json", "broken"), "broken").when(code.between(200, 299) & (candidates == 0), "no_results").when(code.between(200, 299), "success")
        .when(F.startswith(sign, F.lit("network_")), "broken").otherwise("no_results")
    )


def blocked_signature(body: Column, code: Column, kind: Column, headers: Column) -> Column:
    """What stands between a request and its content, by code, headers and body."""
    text, kind, head = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(headers, F.lit("")))
    has = lambda c, *terms: reduce(Column.__or__, [F.contains(c, F.lit(t)) for t in terms])
    page = has(kind, "text/html")
    title = F.substring(F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 60)
    return (
        F.when((code == 429) | has(text, "rate limit", "too many requests"), "rate_limited")
        .when(has(head, "cf-ray") | has(text, "cloudflare", "checking your browser"), "cloudflare_or_browser_challenge").when(code == 403, "blocked")
        .when(has(text, "blocked") & page, "blocked").when(has(text, "login") & has(text, "reddit"), "login_or_auth_challenge").when(has(text, "captcha"), "captcha_challenge")
        .when(page & ~has(kind, "application/json"), F.when(title != "", F.concat(F.lit("html_response:"), title)).otherwise("html_response"))
        .when(text == "", "empty_body").otherwise("none")
    )
